"""Token-id output: flat files of unsigned integers and 64-bit document offsets, memory-mapped when read.

A data set is a folder of shards in ascending doc_id order. Shard p has ``.bin`` (ids, 16 bits where the vocabulary
allows, else 32), ``.idx`` (int64 offsets into .bin, one more than documents) and ``.doc`` (int64 doc_ids). The first id
of a shard in the whole is the sum of the sizes of the shards before it.
"""

from __future__ import annotations

import contextlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import fresh_path

MANIFEST = "shard int, name string, n_docs long, n_nulls long, n_tokens long, width int"


@contextlib.contextmanager
def _create(path: str):
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(path)
        with where.open_output_stream(at) as f:
            yield f
    else:
        with open(_plain(path), "wb") as f:
            yield f


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _mapped(path: str, kind: str) -> np.ndarray:
    """The file's numbers: mapped where the folder is mounted, else read from the store."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(path)
        with where.open_input_file(at) as f:
            return np.frombuffer(f.read(), kind)
    return np.memmap(_plain(path), kind, "r") if os.path.getsize(_plain(path)) else np.zeros(0, kind)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shards: int | None = None) -> list[tuple]:
    """Writes docs (doc_id, text) and returns the manifest with first ids: (shard, name, n_docs, n_nulls, n_tokens, width, start).

    Null texts are empty; each document ends with ``end_id``; null doc_ids come first; of repeated doc_ids the smaller text.
    A task that is run again writes files of other names, and only the manifest's count. The manifest has a row a shard.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        task = TaskContext.get()
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        n_docs = n_nulls = n_tokens = 0
        with _create(f"{folder}/{name}.bin") as bin_, _create(f"{folder}/{name}.idx") as idx, _create(f"{folder}/{name}.doc") as doc:
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                ids = batch.column(0)
                n_nulls += ids.null_count
                doc.write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for _, tokens, bounds in enc.slices(batch.column(1)):
                    size = len(bounds) - 1
                    out = np.full(len(tokens) + size, end_id, kind)
                    body = np.ones(len(out), bool)
                    body[bounds[1:] + np.arange(size)] = False
                    out[body] = tokens
                    bin_.write(out.tobytes())
                    idx.write((n_tokens + bounds[1:] + np.arange(1, size + 1)).astype("<i8").tobytes())
                    n_docs, n_tokens = n_docs + size, n_tokens + len(out)
        row = [task.partitionId(), name, n_docs, n_nulls, n_tokens, int(kind[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["shard", "name", "n_docs", "n_nulls", "n_tokens", "width"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest, start = [], 0
    for r in sorted(map(tuple, rows.mapInArrow(write, MANIFEST).collect())):
        manifest.append((*r, start))
        start += r[4]
    return manifest


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document in the files."""

    def read(batches):
        for batch in batches:
            for _, name, n_docs, n_nulls, _, width, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, idx, doc = _mapped(f"{folder}/{name}.bin", f"<u{width}"), _mapped(f"{folder}/{name}.idx", "<i8"), _mapped(f"{folder}/{name}.doc", "<i8")
                for at in range(0, n_docs, 20_000):
                    bounds = np.array(idx[at : min(n_docs, at + 20_000) + 1])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    docs = pa.array(np.array(doc[at : at + len(crc)]), mask=np.arange(at, at + len(crc)) < n_nulls)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(manifest, f"{MANIFEST}, start long")
    return rows.repartition(max(1, len(manifest)), "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs as token files to the shared folder and returns what the files hold, a row for each document."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, tokenizer, end_id, folder))
