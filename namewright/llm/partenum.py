"""N-gram Jaccard join by PartEnum signatures.

Sets are put into bands by size. For a band, a hash deals the feature domain to first-level partitions, each of three
second-level ones. Two sets at Jaccard similarity 3/4 or more differ in at most (a + b) / 7 features, so in some first-level
partition they differ in one feature at most: there they agree in two of the three second-level partitions. The signatures
of a set are the contents of all subsets of two second-level partitions of each first-level one that aren't empty. A set
near a band's end takes the next band's signatures too.

Features that a sample shows to be frequent, such as passages of many documents, are left out at first. Sets that fill too
few partitions without them have signatures of all their features too, of one of two second-level partitions each (the many
near copies whose features are all frequent then meet in fewer different groups), and, if these are still too few, one a
feature. So no link is lost, whatever the sample.

Pairs of similar size that share a signature are candidates. Their parity sketches, of about a bit a feature, differ in no
more bits than the sets differ in features, which drops nearly all false ones exactly; the complete sets decide on the rest.
Equal sets are one from there on. Groups of more than SMALL documents with a signature aren't paired: each is held against
the group's least, the components of the links found are formed, and then only sets of different components and similar
size are held against each other, in blocks of the families that large groups with the same least member make up.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drawn, written
from .shingles import mixed, shingle_sets

#: Similarity as a fraction; features of a pair that may differ: (a + b) * (DEN - NUM) // (DEN + NUM).
NUM, DEN = 3, 4
#: First-level partitions of a band for each two features that a pair in it may differ in; more than 1, as some are empty.
SPARE = 1.15
#: Documents up to which a group is paired; sets a block; signatures or features held before they are sent.
SMALL, BLOCK, HELD = 16, 1024, 1_000_000
#: What is held frequent: in so many documents of a sample, of this share of all, at least so many; features, those in most documents. Results don't depend on them.
OFTEN, SHARE, SAMPLE, FREQUENT = 3, 1 / 6, 8192, 1 << 19
#: Copies that a task remembers, so that equal sets send their signatures once.
SEEN = 50_000
#: Bits of a filter of documents.
FILTER = (1 << 16, 1 << 25)
#: Pairs of two components in a block that are tried before the components are formed anew; at last all.
ROUNDS = (4, None)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def _concat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def signatures(values: np.ndarray, bounds: np.ndarray, frequent: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of sets given as sorted hashes and bounds; ``frequent``: sorted features that level 0 leaves out.

    Level 0 has subsets of two of three parts without frequent features, level 1, of sets that fill too few partitions there,
    of one of two parts with all features, level 2, of sets that still fill too few, each feature. A partition that holds
    features in two of its parts has a subset left when a feature differs; a set that has more of these than half the features that may differ shares
    a signature with each similar set at that level. If neither of a pair has, both take the next level; in the last, a
    feature in common suffices.
    """
    n = np.diff(bounds)
    band = band_of(np.maximum(n, 1))
    at = np.searchsorted(frequent, values)
    rare = frequent[np.minimum(at, len(frequent) - 1)] != values if len(frequent) else np.ones(len(values), bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    next_band = (n > 0) & (n * DEN >= NUM * (1 << (band + 1)))
    for rows, bands in ((np.flatnonzero(n > 0), band), (np.flatnonzero(next_band), band + 1)):
        for j in np.unique(bands[rows]):
            d = rows[bands[rows] == j]
            largest = (1 << (int(j) + 1)) - 1
            halves = largest * 2 * (DEN - NUM) // (DEN + NUM) // 2 + 1  # more than half of the features that any pair in the band may differ in
            most = (n[d] + np.minimum(n[d] * DEN // NUM, largest)) * (DEN - NUM) // (DEN + NUM)  # features by which a pair may differ
            for level in (0, 1, 2) if len(frequent) else (1, 2):
                if not len(d):
                    break
                own = np.repeat(np.arange(len(d)), n[d])
                index = _concat(bounds[:-1][d], n[d])
                if level == 0:
                    own, index = own[rare[index]], index[rare[index]]
                v = values[index]
                if level == 2:
                    out.append((mixed(v + np.uint64(3 * j + level)), d[own]))
                    break
                each = 3 - level  # second-level partitions of a first-level one
                parts = int(np.ceil(SPARE * halves))
                key = own * np.int64(each * parts) + (mixed(v ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(each * parts)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
                content = np.add.reduceat(mixed(v[order] + np.uint64(5)), first) if len(key) else v
                held = np.zeros(len(d) * each * parts, np.uint64)
                part = (key[first] % (each * parts)).astype(np.uint64)
                held[key[first]] = mixed(content + mixed(part * np.uint64(1_000_003) + np.uint64(3 * j + level))) | np.uint64(1)
                held = held.reshape(-1, each)
                full = ((held != 0).sum(1) >= 2).reshape(len(d), parts).sum(1)
                for subset in ((0, 1), (0, 2), (1, 2)) if each == 3 else ((0,), (1,)):
                    some = np.flatnonzero((held[:, subset] != 0).any(1))
                    whole = sum((held[some, x] * np.uint64(2 * i + 1) for i, x in enumerate(subset)), np.zeros(len(some), np.uint64))
                    out.append((mixed(whole + np.uint64(11 + sum(subset))), d[some // parts]))
                few = full <= most // 2
                d, most = d[few], most[few]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parities of the features by their hash's lower bits, a power of two of bits, at least 64 and as many as features."""
    n = np.diff(bounds)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.concatenate(([0], np.cumsum(width)))
    at = np.repeat(start[:-1], n) + (values & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in pairwise(start.tolist())]


def _close(n: int, a: int, bits_a: int, m: int, b: int, bits_b: int) -> bool:
    """Whether sketches a and b of sets of n and m features leave room for the similarity."""
    if n * DEN < m * NUM or m * DEN < n * NUM:
        return False
    while bits_a > bits_b:
        bits_a >>= 1
        a = (a >> bits_a) ^ (a & ((1 << bits_a) - 1))
    while bits_b > bits_a:
        bits_b >>= 1
        b = (b >> bits_b) ^ (b & ((1 << bits_b) - 1))
    return (a ^ b).bit_count() <= (n + m) * (DEN - NUM) // (DEN + NUM)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what their upper bytes have in common compresses."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; None for an empty one."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out: list[bytes | None] = [None] * len(n)
    if len(some):
        sums = np.stack([mixed(np.add.reduceat(mixed(values + np.uint64(salt)), bounds[:-1][some]) + n[some].astype(np.uint64)) for salt in (0x1234567, 0xABCDEF01)], 1)
        for i, row in zip(some.tolist(), sums, strict=True):
            out[i] = row.tobytes()
    return out


def _profile(batches):
    for batch in batches:
        for at, values, bounds in shingle_sets(batch.column(1)):
            n = np.diff(bounds)
            columns = [pa.array(n, pa.int64()), pa.array(fingerprints(values, bounds), pa.binary()), pa.array(sketches(values, bounds), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), *columns], ["doc_id", "n_shingles", "fp", "sketch"])


def _bucket_runs(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(order by bucket and hash, buckets so ordered, where they begin)."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(n_buckets)
    order = np.lexsort((hashes, bucket))
    bucket = bucket[order].astype(np.int32)
    return order, bucket, np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist() if len(bucket) else [0]


def _steps(x: np.ndarray) -> bytes:
    """Rising numbers as their differences."""
    s = x.copy()
    s[1:] -= x[:-1]
    return _planes(s)


def _rising(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def _feature_blocks(n_buckets: int):
    """Of the features of many documents: for each bucket the distinct ones and their numbers of documents."""

    def run(batches):
        held: list[np.ndarray] = []

        def send():
            if not held:
                return
            features, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            order, bucket, cuts = _bucket_runs(features, n_buckets)
            features, counts = features[order], counts[order].astype(np.int64)
            for a, b in pairwise(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 1]), pa.array([_steps(features[a:b])], pa.binary()), pa.array([_planes(counts[a:b])], pa.binary())], ["bucket", "features", "counts"])

        for batch in batches:
            for _, values, _ in shingle_sets(batch.column(0)):
                held.append(values)
                if sum(map(len, held)) > HELD:
                    yield from send()
        yield from send()

    return run


def _by_bucket(batches):
    """The rows of each bucket, which follow each other, as lists of their other columns."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and rows:
                yield rows
                rows = []
            bucket = b
            rows.append(row)
    if rows:
        yield rows


def _often(batches):
    for rows in _by_bucket(batches):
        features, at = np.unique(np.concatenate([_rising(f) for f, _ in rows]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([_numbers(c, np.int64) for _, c in rows]), len(features)).astype(np.int64)
        some = counts >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(features[some].view(np.int64)), pa.array(counts[some])], ["feature", "n"])


def _signature_blocks(n_buckets: int, bits: int, frequent: np.ndarray):
    """Signatures of ``bits`` bits of many documents, by bucket; of equal sets that a task still remembers those of the first."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[bytes] = set()

        def send():
            if not held:
                return
            sig, doc, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, bucket, cuts = _bucket_runs(sig, n_buckets)
            sig, doc, size = sig[order], doc[order], size[order]
            for a, b in pairwise(cuts):
                s, base = sig[a:b] >> np.uint64(64 - bits), doc[a:b].min()
                data = [_steps(s), _planes(doc[a:b] - base), size[a:b].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 1]), pa.array([base], pa.int64()), *[pa.array([x], pa.binary()) for x in data]], ["bucket", "base", "sigs", "docs", "sizes"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, values, bounds in shingle_sets(batch.column(1)):
                sig, row = signatures(values, bounds, frequent)
                fps = fingerprints(values, bounds)
                fresh = np.ones(len(fps), bool)
                for i, fp in enumerate(fps):
                    if fp in seen:
                        fresh[i] = False
                    elif fp and len(seen) < SEEN:
                        seen.add(fp)
                sig, row = sig[fresh[row]], row[fresh[row]]
                if len(sig):
                    size = np.floor(16 * np.log2(np.diff(bounds)[row])).astype(np.int64).astype(np.uint8)
                    held.append((sig, ids[at + row], size))
                if sum(len(s) for s, _, _ in held) > HELD:
                    yield from send()
        yield from send()

    return run


#: By how many sixteenths of a doubling, rounded down, sizes of similar sets can lie apart.
APART = int(np.ceil(16 * np.log2(DEN / NUM))) + 1


def _groups(batches):
    """Of the signatures of a bucket: candidate pairs (u < v) of similar size; of groups too large to be paired the pairs with the least member."""
    for rows in _by_bucket(batches):
        sig = np.concatenate([_rising(s) for _, s, _, _ in rows])
        doc = np.concatenate([base + _numbers(d, np.int64) for base, _, d, _ in rows])
        size = np.concatenate([np.frombuffer(z, np.uint8) for _, _, _, z in rows]).astype(np.int16)
        order = np.lexsort((size, doc, sig))
        sig, doc, size = sig[order], doc[order], size[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]) | (size[1:] != size[:-1])
        sig, doc, size = sig[new], doc[new], size[new]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.concatenate((start, [len(sig)])))
        found = [np.zeros((0, 2), np.int64)]
        for g in range(2, SMALL + 1):
            if len(own := start[count == g]):
                m = own[:, None] + np.arange(g)
                i, j = (m[:, x].ravel() for x in np.triu_indices(g, 1))
                gap = np.abs(size[i] - size[j])
                near = (np.minimum(gap, 256 - gap) <= APART) & (doc[i] != doc[j])
                found.append(np.unique(np.stack((doc[i[near]], doc[j[near]]), 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        big = count > SMALL
        inside = _concat(start[big] + 1, count[big] - 1)
        stars = np.stack((doc[np.repeat(start[big], count[big] - 1)], doc[inside]), 1)
        stars = np.unique(stars[stars[:, 0] != stars[:, 1]], axis=0)
        for edges, large in ((pairs, False), (stars, True)):
            for at in range(0, len(edges), 100_000):
                p = edges[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(np.full(len(p), large))], ["u", "v", "large"])


def _sketch_filter(batches):
    """Drops pairs (..., n, m, sketch, sketch) whose sketches are too far apart, and these columns."""
    for batch in batches:
        n, m, a, b = (c.to_pylist() for c in batch.columns[-4:])
        keep = [_close(n[i], int.from_bytes(a[i], "little"), 8 * len(a[i]), m[i], int.from_bytes(b[i], "little"), 8 * len(b[i])) for i in range(len(n))]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:-4]], batch.schema.names[:-4])


def _sets(bits: np.ndarray):
    """Complete sets of the documents that a filter, ``bits``, lets through."""

    def run(batches):
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for at, values, bounds in shingle_sets(batch.column(1)):
                blobs = [values[a:b].tobytes() for a, b in pairwise(bounds.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(blobs)), pa.array(fingerprints(values, bounds), pa.binary()), pa.array(blobs, pa.binary())], ["doc_id", "fp", "features"])

    return run


def _similar(batches):
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(DEN * common >= NUM * (len(both) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["u", "v"])


#: A pair of sets: least document and fingerprint of each.
PAIR = "u long, u_fp binary, v long, v_fp binary"


def _across(limit: int | None):
    """Of blocks of a unit's sets: pairs of different components whose sketches are close, the closest ``limit`` of two components.

    A unit has the sets of a family of one size band (``upper`` false), and of the next, which aren't held against each other.
    """

    def pairs(left: list, right: list | None) -> list[tuple]:
        found: dict[tuple, list] = {}
        other = left if right is None else right
        if not other:
            return []
        n, comp, upper = (np.array([x[i] for x in other]) for i in (3, 2, 6))
        for i, (doc, fp, c, size, sketch, bits, up) in enumerate(left):
            fits = (comp != c) & (n * DEN >= size * NUM) & (n * NUM <= size * DEN) & ~(upper & up)
            if right is None:
                fits[: i + 1] = False
            for k in np.flatnonzero(fits):
                doc_k, fp_k, comp_k, size_k, sketch_k, bits_k, _ = other[k]
                if _close(size, sketch, bits, size_k, sketch_k, bits_k):
                    pair = min((doc, fp), (doc_k, fp_k)) + max((doc, fp), (doc_k, fp_k))
                    found.setdefault((min(c, comp_k), max(c, comp_k)), []).append((abs(size - size_k), *pair))
        return [x[1:] for v in found.values() for x in (v if limit is None else sorted(v)[:limit])]

    def run(batches):
        key, left, right = None, [], []

        def done():
            out = sorted(set(pairs(left, right if key[2] != key[3] else None)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary()) * 2)], ["u", "u_fp", "v", "v_fp"])

        for batch in batches:
            for family, unit, i, j, side, doc, fp, comp, n, sketch, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, unit, i, j) != key:
                    if key:
                        yield done()
                    key, left, right = (family, unit, i, j), [], []
                (left if side == i else right).append((doc, fp, comp, n, int.from_bytes(sketch, "little"), 8 * len(sketch), upper))
        if key:
            yield done()

    return run


class _Join:
    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
        profile = written(self.rows.mapInArrow(_profile, "doc_id long, n_shingles long, fp binary, sketch binary"), "profile")
        first = profile.filter("doc_id is not null").groupBy(F.col("fp").alias("rep_fp")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
        first = first.filter("rep_fp is not null and c > 1").drop("c")
        #: A row a row of docs; rep: the least document of an equal set.
        self.known = written(profile.join(first, F.col("fp") == F.col("rep_fp"), "left").select("doc_id", "n_shingles", "fp", "sketch", F.coalesce("rep", "doc_id").alias("rep")), "known")
        self.sets = self.known.filter("doc_id is not null and n_shingles > 0")
        total = self.sets.agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("features")).first()
        self.n_sets, self.n_features = total["sets"], total["features"] or 0

    def first_of_equals(self) -> DataFrame:
        """Rows without the documents all of whose sets a smaller document has: equal sets have equal signatures, so one gives them all.

        The ids to be left out are written first, so that their size is known before any text is dealt: below Spark's
        threshold they are broadcast, beyond it rows are joined by doc_id.
        """
        later = self.known.filter("doc_id is not null").groupBy(F.col("doc_id").alias("later")).agg(F.max(F.col("rep") == F.col("doc_id")).alias("first"))
        later = written(later.filter("not first").select("later"), "later")
        return self.rows.filter("doc_id is not null").join(later, F.col("doc_id") == F.col("later"), "left_anti")

    def frequent(self) -> np.ndarray:
        """Features of several documents of a sample by md5 of doc_id. They only steer which signatures are made, never which links are found."""
        share = max(SHARE, min(1.0, SAMPLE / max(1, self.n_sets)))
        sample = self.rows.filter("doc_id is not null").filter(drawn(F.col("doc_id")) < share).select("text")
        blocks = sample.mapInArrow(_feature_blocks(self.n), "bucket int, features binary, counts binary")
        counts = written(blocks.repartition(self.n, "bucket").sortWithinPartitions("bucket").mapInArrow(_often, "feature long, n long"), "features")
        scale = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()  # 256 rows at most
        least, held = None, 0
        for r in scale:
            held += r["c"]
            if held > FREQUENT:
                break
            least = r["n"]
        if least is None:
            return np.zeros(0, np.uint64)
        found = counts.filter(F.col("n") >= least).select("feature").toArrow()  # FREQUENT rows at most
        return np.sort(found.column(0).to_numpy().view(np.uint64))

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(u, v) of pairs of documents, and of those of large groups with the group's least."""
        bits = min(64, 24 + max(1, self.n_features).bit_length())  # shorter ones would make candidates by chance
        blocks = self.first_of_equals().mapInArrow(_signature_blocks(4 * self.n, bits, self.frequent()), "bucket int, base long, sigs binary, docs binary, sizes binary")
        found = written(blocks.repartition(self.n, "bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "u long, v long, large boolean"), "groups")
        return found.select("u", "v").distinct(), found.filter("large").select("u", "v").distinct()

    def _side(self, side: str, *columns: str) -> DataFrame:
        return self.sets.select(F.col("doc_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])

    def close(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs of sets of these documents whose sizes and sketches allow the similarity."""
        a, b = (self._side(s, "rep", "fp", "n_shingles", "sketch") for s in "ab")
        both = pairs.join(a, F.col("u") == F.col("a_id")).join(b, F.col("v") == F.col("b_id")).filter(F.col("a_fp") != F.col("b_fp"))
        both = both.filter((F.col("a_n_shingles") * DEN >= F.col("b_n_shingles") * NUM) & (F.col("b_n_shingles") * DEN >= F.col("a_n_shingles") * NUM))
        rising = F.col("a_rep") < F.col("b_rep")
        pick = lambda x, y, c: F.when(rising, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}"))
        columns = [pick("a", "b", "rep").alias("u"), pick("a", "b", "fp").alias("u_fp"), pick("b", "a", "rep").alias("v"), pick("b", "a", "fp").alias("v_fp")]
        both = both.select(*columns, "a_n_shingles", "b_n_shingles", "a_sketch", "b_sketch")
        return both.mapInArrow(_sketch_filter, PAIR).distinct()

    def _filter(self, ids: DataFrame) -> np.ndarray:
        """A bit for each place that a document of ids hashes to; of bounded size, false positives do no harm."""
        size = FILTER[0]
        n = ids.count()
        while size < min(16 * n, FILTER[1]):
            size *= 2
        place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
        words = ids.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {size}) % 64 as int))").alias("b"))
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # FILTER[1] / 64 rows at most
        bits = np.zeros(size // 64, np.uint64)
        bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
        return bits

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that reach the similarity, by their complete sets."""
        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
        bits = self._filter(ends)
        placed = self.rows.filter("doc_id is not null").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(64 * len(bits))))
        sets = written(placed.mapInArrow(_sets(bits), "doc_id long, fp binary, features binary"), "sets")
        side = lambda s: sets.select(F.col("doc_id").alias(f"{s}_id"), F.col("fp").alias(f"{s}_fp_"), F.col("features").alias(f"{s}_features"))
        both = pairs.join(side("b"), (F.col("v") == F.col("b_id")) & (F.col("v_fp") == F.col("b_fp_"))).join(side("a"), (F.col("u") == F.col("a_id")) & (F.col("u_fp") == F.col("a_fp_")))
        return written(both.select("u", "v", "a_features", "b_features").mapInArrow(_similar, "u long, v long"), "links")

    def across(self, stars: DataFrame, labels: DataFrame, limit: int | None) -> DataFrame:
        """Close pairs of sets of different components in the families that hold several: all large groups with the same least member are one family."""
        member = stars.select(F.col("u").alias("family"), F.col("v").alias("doc")).unionByName(stars.select(F.col("u").alias("family"), F.col("u").alias("doc")).distinct())
        member = member.join(self._side("k", "rep", "fp", "n_shingles", "sketch"), F.col("doc") == F.col("k_id")).dropDuplicates(["family", "k_fp"])
        member = member.join(labels, F.col("k_rep") == F.col("node"), "left")
        band: Column = F.floor(F.log("k_n_shingles") / F.log(F.lit(DEN / NUM)))
        twice = F.explode(F.array(*[F.struct((band - F.lit(k)).alias("unit"), F.lit(bool(k)).alias("upper")) for k in (0, 1)]))
        member = member.select("family", "k_rep", "k_fp", "k_n_shingles", "k_sketch", F.coalesce("component", "k_rep").alias("comp"), twice.alias("x")).select("*", "x.unit", "x.upper")
        open_ = member.groupBy(F.col("family").alias("f"), F.col("unit").alias("u")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("upper").alias("none"), F.floor((F.count("*") - 1) / BLOCK).cast("int").alias("last"))
        open_ = open_.filter("low <> high and not none").select("f", "u", "last")
        member = member.join(open_, (F.col("family") == F.col("f")) & (F.col("unit") == F.col("u"))).withColumn("block", F.pmod(F.xxhash64("k_fp"), F.col("last") + 1).cast("int"))
        units = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        key = ["family", "unit", "i", "j"]
        units = units.select("family", "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "k_rep", "k_fp", "comp", "k_n_shingles", "k_sketch", "upper")
        return units.repartition(self.n, *key).sortWithinPartitions(*key).mapInArrow(_across(limit), PAIR).distinct()

    def copies(self) -> DataFrame:
        """Links of documents of several texts with the least document of each."""
        several = self.known.filter("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.countDistinct(F.coalesce("fp", F.lit(b""))).alias("c")).filter("c > 1")
        return self.sets.join(several, F.col("doc_id") == F.col("d")).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns are ignored).

    Sets: distinct shingles of five words, the whole sequence of shorter texts. Null and empty texts have none and link with
    nothing; nor do rows of a null doc_id, whose component is null. Rows of one doc_id are one document, which links by the
    set of each; n_shingles is the row's own. No documents, no rows. The result doesn't depend on the order of rows.
    """
    join = _Join(docs)
    pairs, stars = join.candidates()
    links = join.links(join.close(pairs)).unionByName(written(join.copies(), "copies"))
    labels = components(links)
    if not stars.isEmpty():
        for limit in ROUNDS:
            more = join.across(stars, labels, limit)
            links = links.unionByName(join.links(more))
            labels = components(links)
    labels = labels.select(F.col("node").alias("__node"), "component")
    return join.known.join(labels, F.col("rep") == F.col("__node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their component, with all their columns; rows of a null doc_id stay."""
    away = jaccard_components(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("__away")).distinct()
    return docs.join(away, F.col("doc_id") == F.col("__away"), "left_anti")
