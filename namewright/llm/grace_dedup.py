"""Exact deduplication by Grace hashing with a complete comparison of contents.

Records are dealt out by a 64-bit hash of their normalised text: by Spark's shuffle first, then, within a task whose
distinct contents exceed its budget, to spill files, again and again, until each bucket fits an open-addressing table.
Copies within an input partition meet in a table before the shuffle, so a text that a third of all rows hold crosses it
once a partition at most.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bytes of distinct contents that a table may hold.
BUDGET = 48 << 20
#: Spill files a level, as a power of two.
FAN_BITS = 4
WHITE = r"[\x20\x09-\x0D]+"


class ContentTable:
    """Open addressing with linear probing; an entry is equal only if its complete content is."""

    def __init__(self):
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.states: list[list] = []
        self.held = 0

    def find(self, h: int, content: str) -> tuple[int, bool]:
        """Entry of the content, and whether it is new."""
        i = (h ^ (h >> 29)) & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & self.mask
        self.slots[i] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.states.append([])
        self.held += len(content) + 100
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            i = (h ^ (h >> 29)) & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


def grace(records: Iterable[tuple[int, str, list]], merge, budget: int = BUDGET, level: int = 0) -> Iterator[tuple]:
    """(hash, content, state) once for each distinct content; ``merge(into, state)`` adds a further record's state.

    What ``merge`` returns, unless it is None, comes at once as (None, None, it); so a state needn't hold what its records leave.
    The first record of a content is always the one that the others are merged into, through all levels of spill files. The
    files are private to the task: they are deleted with it, and a task that is run again writes its own.
    """
    table = ContentTable()
    records = iter(records)
    for h, content, state in records:
        e, new = table.find(h, content)
        if new:
            table.states[e] = state
        elif (left := merge(table.states[e], state)) is not None:
            yield None, None, left
        if table.held > budget and len(table.hashes) > 1 and level * FAN_BITS < 64:
            break
    else:
        yield from zip(table.hashes, table.contents, table.states, strict=True)
        return
    fan = 1 << FAN_BITS
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(f"{folder}/{i}", "w+b") for i in range(fan)]  # noqa: SIM115
        try:
            for source in (zip(table.hashes, table.contents, table.states, strict=True), records):
                for record in source:
                    pickle.dump(record, files[(record[0] >> (60 - level * FAN_BITS)) & (fan - 1)], 5)
            del table
            for f in files:
                f.seek(0)
                yield from grace(_read(f), merge, budget, level + 1)
                f.truncate(0)
        finally:
            for f in files:
                f.close()


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _before(a: tuple, b: tuple) -> bool:
    """Whether row a = (doc_id, row) stays rather than b; a null doc_id comes last."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _local(batches):
    """Of an input partition: a row for each document (row, doc_id, copy_of), and for each distinct text its summary.

    copy_of is the first row with the text. Later rows go out when they meet it, so the table holds contents only, however many
    copies they have; the first row goes last, with the content, its rows' number, and the least doc_id and its row.
    """
    base, out = TaskContext.get().partitionId() << 33, []
    schema = pa.schema([*((c, pa.int64()) for c in ("row", "doc_id", "copy_of", "n", "h", "least_id", "least_row")), ("content", pa.string())])

    def flush():
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    def rows():
        at = base
        for batch in batches:
            ids = batch.column(0).to_pylist()
            hashes = batch.column(2).to_pylist()
            for i, (d, h) in enumerate(zip(ids, hashes, strict=True)):
                yield h, batch.column(1)[i].as_py(), [at, d, (d, at), 1]
                at += 1

    def merge(into, state):
        if _before(state[2], into[2]):
            into[2] = state[2]
        into[3] += state[3]
        return state[0], state[1], into[0], None, None, None, None, None

    size = 0
    for h, content, state in grace(rows(), merge):
        if h is not None:
            row, doc, least, n = state
            state = row, doc, row, n, h, *least, content
            size += len(content)
        out.append(state)
        if len(out) >= 2000 or size > 4 << 20:
            yield flush()
            size = 0
    yield flush()


def _global(batches):
    """Of a hash partition: for each text of an input partition (copy_of) the row that stays, the group's size and digest.

    A text's state holds one row of each input partition that has it.
    """
    schema = pa.schema([("lead", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def rows():
        for batch in batches:
            lead, doc, row, n, h = (batch.column(i).to_pylist() for i in range(5))
            for i in range(len(row)):
                yield h[i], batch.column(5)[i].as_py(), [(doc[i], row[i]), n[i], [lead[i]]]

    def merge(into, state):
        if _before(state[0], into[0]):
            into[0] = state[0]
        into[1] += state[1]
        into[2] += state[2]

    out: list[tuple] = []

    def flush():
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    for _, content, (first, n, leads) in grace(rows(), merge):
        digest = hashlib.sha256(content.encode()).hexdigest()
        for lead in leads:
            out.append((lead, first[1], first[0], n, digest))
            if len(out) >= 10_000:
                yield flush()
    yield flush()


def exact_dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text; other columns are ignored).

    Texts are equal if they are after each run of ASCII white space is one space; null counts as empty. The row with the
    smallest doc_id stays (null comes last), of repeated rows one. No documents, no rows.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE, " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("content")).select("doc_id", "content", F.xxhash64("content").alias("h"))
    local = written(rows.mapInArrow(_local, "row long, doc_id long, copy_of long, n long, h long, least_id long, least_row long, content string"), "dedup")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = local.filter("content is not null").select("row", "least_id", "least_row", "n", "h", "content").repartition(n, "h").mapInArrow(_global, "lead long, keep_row long, keep_id long, group_size long, text_sha256 string")
    return local.select("row", "doc_id", "copy_of").join(groups, F.col("copy_of") == F.col("lead")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of repeated rows one.

    The keys have no nulls, so rows that the join has put together needn't be dealt again to drop repeated ones.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    col = lambda name: F.col(names[docs.columns.index(name)])
    id_key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    text_key = F.sha2(F.regexp_replace(F.coalesce(col("text").cast("string"), F.lit("")), WHITE, " "), 256)
    kept = exact_dedup(docs).filter("kept").select(id_key(F.col("doc_id")).alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    keyed = docs.toDF(*names).withColumns({"__id": id_key(col("doc_id")), "__sha": text_key})
    found = keyed.join(kept, (F.col("__id") == F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")), "left_semi")
    return found.dropDuplicates(["__id", "__sha"]).select(*names).toDF(*docs.columns)
