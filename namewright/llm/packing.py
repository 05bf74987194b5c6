"""Best-fit packing of documents into sequences by linear grouping.

Lengths below the limit take at most limit - 1 values, so the whole plan is made from their histogram, whose size doesn't
depend on the corpus: large lengths are rounded up to the largest of their group of equal cardinality, the configurations
of these few sizes are optimised (a linear program by column generation, rounded down), actual documents take the slots of
their group, and what is left over, and small lengths, go where they fit best.
The plan is a list of runs: the documents of one length with ranks a to b go to sequences from s on. Documents find
their place by their rank, which is a count within an input partition plus a prefix sum over partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import written

#: Lengths above this share of the limit are large.
LARGE = 1 / 5
#: Groups of equal cardinality, and so the most sizes that configurations are made of.
GROUPS = 64
#: Rounds of column generation for each size, at most; the plan holds whenever it stops.
COLUMNS = 30


def _groups(hist: dict[int, int], n_groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[size, count], ...]) of groups of equal cardinality, sizes falling; groups rounded alike are one."""
    total = sum(hist.values())
    each, out, room = max(1, -(-total // n_groups)), [], 0
    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            if not room:
                room = each
                if not out or out[-1][0] != size:
                    out.append((size, []))
            n = min(left, room)
            out[-1][1].append([size, n])
            left, room = left - n, room - n
    return out


def _richest(sizes: np.ndarray, worth: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The configuration of the largest worth, by dynamic programming over its length; sizes fall."""
    rising, value, pick = sizes[::-1], np.zeros(limit + 1), np.full(limit + 1, -1)
    own = worth[::-1]
    for room in range(1, limit + 1):
        k = int(np.searchsorted(rising, room, "right"))
        value[room] = value[room - 1]
        if k:
            got = value[room - rising[:k]] + own[:k]
            best = int(got.argmax())
            if got[best] > value[room] + 1e-12:
                value[room], pick[room] = got[best], len(sizes) - 1 - best
    config, room = np.zeros(len(sizes)), limit
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            config[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(value[limit]), config


def configurations(sizes: list[int], counts: list[int], limit: int) -> list[tuple[dict[int, int], int]]:
    """({size index: number}, times): a near-optimal choice of configurations, rounded down; no size is used more often than it occurs.

    Simplex over configurations: a round adds the one that is worth most at the current prices of sizes.
    """
    if not sizes:
        return []
    s, need = np.array(sizes), np.array(counts, float)
    basis = np.diag(np.floor(limit / s))
    x = need / np.diag(basis)
    for _ in range(COLUMNS * len(sizes)):
        price = np.linalg.solve(basis.T, np.ones(len(s)))
        worth, config = _richest(s, price, limit)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, config)
        some = step > 1e-9
        if not some.any():
            break
        ratio = np.where(some, x / np.where(some, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        basis[:, out], x[out] = config, ratio[out]
    left, found = list(counts), []
    for j in np.argsort(-x, kind="stable").tolist():
        config = {t: int(n) for t, n in enumerate(basis[:, j]) if n}
        times = min([int(x[j] + 1e-6), *(left[t] // n for t, n in config.items())])
        if times:
            found.append((config, times))
            for t, n in config.items():
                left[t] -= n * times
    return found


def make_plan(hist: dict[int, int], limit: int, n_groups: int = GROUPS) -> tuple[int, list[tuple]]:
    """Number of sequences, and runs (size, rank_from, rank_to, sequence_from, per_sequence, offset) that place every rank."""
    groups = _groups({s: n for s, n in hist.items() if s > limit * LARGE}, n_groups)
    runs, ranks, n_seq = [], defaultdict(int), 0
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for config, times in configurations([g[0] for g in groups], [sum(n for _, n in g[1]) for g in groups], limit):
        slots = []
        for t, n in config.items():
            for _ in range(n):
                cut, have = [], 0
                while have < times:
                    size, count = groups[t][1][0]
                    k = min(count, times - have)
                    cut.append((have, have + k, size, ranks[size] - have))
                    ranks[size] += k
                    have += k
                    groups[t][1][0][1] -= k
                    if not groups[t][1][0][1]:
                        groups[t][1].pop(0)
                slots.append(cut)
        edges = sorted({a for cut in slots for a, *_ in cut} | {times})
        at = [0] * len(slots)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            used = 0
            for j, cut in enumerate(slots):
                while cut[at[j]][1] <= a:
                    at[j] += 1
                _, _, size, base = cut[at[j]]
                runs.append((size, base + a, base + b, n_seq + a, 1, used))
                used += size
            if used < limit:
                rooms[limit - used].append((n_seq + a, b - a))
        n_seq += times
    keys = sorted(rooms)
    for size in sorted(hist, reverse=True):
        rank, count = ranks[size], hist[size] - ranks[size]
        while count:
            i = bisect_left(keys, size)
            if i == len(keys):
                new = -(-count // (limit // size))
                rooms[limit].append((n_seq, new))
                insort(keys, limit)
                n_seq += new
                continue
            room = keys[i]
            first, m = rooms[room].pop()
            if not rooms[room]:
                keys.pop(i)
            per = room // size
            full = min(m, count // per)
            for seq, bins, each in ((first, full, per), (first + full, int(full < m and count - full * per > 0), count - full * per)):
                if bins:
                    runs.append((size, rank, rank + bins * each, seq, each, limit - room))
                    rank, count = rank + bins * each, count - bins * each
                    rest = room - each * size
                    if rest:
                        if not rooms[rest]:
                            insort(keys, rest)
                        rooms[rest].append((seq, bins))
                    m, first = m - bins, first + bins
            if m:
                if not rooms[room]:
                    insort(keys, room)
                rooms[room].append((first, m))
    return n_seq, runs


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """doc_id, n (ids), crcs (of the pieces), part (input partition), size (of the shorter first piece, or 0), rank and full_before within the partition."""

    def run(batches):
        enc, seen, full, part = encoder(tokenizer), defaultdict(int), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at, ids, bounds in enc.slices(batch.column(1)):
                n, crcs, size, rank, before = [], [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    data = ids[a:b].tobytes() + end_id.to_bytes(4, "little")
                    k, s = len(data) // 4, (len(data) // 4) % limit
                    cuts = [0, *range(4 * s or 4 * limit, len(data) + 1, 4 * limit)]
                    n.append(k)
                    crcs.append([zlib.crc32(data[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
                    size.append(s)
                    rank.append(seen[s])
                    before.append(full)
                    seen[s] += 1
                    full += k // limit
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, m), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(np.full(m, part, np.int32)), pa.array(size, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64())],
                    ["doc_id", "n", "crcs", "part", "size", "rank", "full_before"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, crcs array<long>, part int, size int, rank long, full_before long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of docs (doc_id, text).

    A null or empty text is its end id alone. Documents over the limit are cut into pieces of that length but for the first.
    Repeated rows are packed each; no documents, no rows.
    """
    spark = docs.sparkSession
    rows = written(_encoded(docs, tokenizer, end_id, limit), "encoded")
    by_part = rows.groupBy("part", "size").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / limit)).alias("f"))
    counts = written(by_part, "lengths")
    hist = {r["size"]: r["c"] for r in counts.filter("size > 0").groupBy("size").agg(F.sum("c").alias("c")).collect()}  # limit - 1 rows at most
    n_seq, runs = make_plan(hist, limit)
    plan = spark.createDataFrame(runs, "p_size int, rank_from long, rank_to long, seq_from long, per long, at int")
    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(F.col("part").alias("b_part"), F.col("size").alias("b_size"), F.coalesce(F.sum("c").over(earlier("size")), F.lit(0)).alias("base"))
    fulls = counts.groupBy("part").agg(F.sum("f").alias("f"))
    fulls = fulls.select(F.col("part").alias("f_part"), F.coalesce(F.sum("f").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("f_base"))
    r = rows.join(ranks, (F.col("part") == F.col("b_part")) & (F.col("size") == F.col("b_size"))).join(fulls, F.col("part") == F.col("f_part"))
    r = r.withColumn("rank", F.col("rank") + F.col("base"))
    # The plan has at most a few runs a length below the limit, whatever the corpus: a bounded broadcast.
    r = r.join(F.broadcast(plan), (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")), "left")
    short = F.col("size") > 0
    nth = F.col("rank") - F.col("rank_from")
    first = F.when(short, F.col("size")).otherwise(limit)
    r = r.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    own = short & (F.col("piece") == 0)
    return r.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * limit).cast("long").alias("start"),
        F.when(own, F.col("size")).otherwise(limit).cast("long").alias("length"),
        "ids_crc32",
        F.when(own, F.col("seq_from") + F.floor(nth / F.col("per"))).otherwise(F.lit(n_seq) + F.col("f_base") + F.col("full_before") + F.col("piece") - short.cast("int")).cast("long").alias("sequence_id"),
        F.when(own, F.col("at") + nth % F.col("per") * F.col("size")).otherwise(0).cast("long").alias("offset"),
    )
