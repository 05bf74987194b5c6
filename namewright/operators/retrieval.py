"""Similarity search: exact and inverted-file nearest neighbours of vectors, character TF-IDF, reranking by edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are rounded before ranks are given, so that ties don't hang on the order of additions.
DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors that a task holds at most of the corpus, and of the queries.
SHARD, QUERIES = 200_000, 50_000
#: Products that a task of the inverted file holds at a time.
PRODUCTS = 4_000_000


def exact_neighbors(queries: DataFrame, corpus: DataFrame, k: int, block: int = 2048, shard: int = SHARD, part: int = QUERIES) -> DataFrame:
    """(query_id, target_id, score, rank): the k largest inner products, own row left out, ties to smaller ids. Both: (id, v).

    Parts of the queries meet shards of the corpus, both of bounded size; each task multiplies matrices and keeps k a query.
    """
    shards = max(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-corpus.count() // shard))
    parts = max(1, -(-queries.count() // part))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    c = corpus.select("id", "v", own(shards).alias("shard"), every(parts).alias("part"))
    q = queries.select("id", "v", own(parts).alias("part"), every(shards).alias("shard"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, m = right["id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(np.float64)
            for at in range(0, len(left), block):
                few = left.iloc[at : at + block]
                q_ids = few["id"].to_numpy()
                s = np.round(np.stack(few["v"].to_numpy()).astype(np.float64) @ m.T, DIGITS)
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, top, 1)
                out.append(pd.DataFrame({"query_id": np.repeat(q_ids, top.shape[1]), "target_id": ids[top].ravel(), "score": score.ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "target_id": [], "score": []})
        return found[np.isfinite(found["score"].astype(float))]

    rows = q.groupBy("shard", "part").cogroup(c.groupBy("shard", "part")).applyInPandas(best, "query_id long, target_id long, score double")
    return ranked(rows, k)


def ranked(rows: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """rank by falling score, ties to smaller ids; Spark drops all but k of a query before the shuffle."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "target_id")))
    return out.filter(F.col("rank") <= k) if k else out


def _nearest(centroids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    d = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def finite(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and vectors of the rows whose components are finite."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty((0, 0))
    rows = rows.sort_values("id")
    m = np.stack(rows["v"].to_numpy()).astype(np.float64)
    keep = np.isfinite(m).all(1)
    return rows["id"].to_numpy()[keep], m[keep]


def largest(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, id) of the k largest finite scores a row, ties to smaller ids; ids: of the columns, rising."""
    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    row, col = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
    score = s[row, col]
    order = np.lexsort((col, -score, row))  # rows keep their places
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    order = order[nth < k]
    return row[order], score[order], ids[col[order]]


class InvertedFile:
    """Inverted-file index: centroids from a bounded sample, every vector in its cell, ``probe`` cells searched."""

    def __init__(self, corpus: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 42):
        self.corpus = corpus
        rows = corpus.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(sample).collect()
        x = np.array([r["v"] for r in rows], np.float64)
        rng = np.random.default_rng(seed)
        self.centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            own = _nearest(self.centroids, x, 1)[:, 0]
            self.centroids = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(self.centroids)])

    def _cells(self, rows: DataFrame, n: int) -> DataFrame:
        centroids = self.centroids  # cells times dimensions, whatever the corpus

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            return pd.Series(list(_nearest(centroids, np.stack(v.to_numpy()).astype(np.float64), n).astype(np.int32))) if len(v) else v

        return rows.withColumn("cell", F.explode(cells("v")))

    def search(self, queries: DataFrame, k: int, probe: int = 4, shard: int = SHARD, part: int = QUERIES) -> DataFrame:
        """(query_id, target_id, score, rank): the k largest inner products in the probed cells, own row left out, ties to smaller ids.

        A cell is dealt to shards, and the queries to parts, of bounded size; each task multiplies matrices and keeps k a query.
        """
        c = self._cells(self.corpus, 1)
        sizes = {r["cell"]: r["count"] for r in c.groupBy("cell").count().collect()}  # a row a cell
        tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
        shards = {i: max(-(-n // shard), round(tasks * n / sum(sizes.values())), 1) for i, n in sizes.items()}
        parts = max(1, -(-queries.count() // part))
        of = F.element_at(F.array(*[F.lit(shards.get(i, 1)) for i in range(max(1, len(self.centroids)))]), F.col("cell") + 1)
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        c = c.select("cell", own(of).alias("shard"), "id", "v").withColumn("part", every(F.lit(parts)))
        q = self._cells(queries, probe).select("cell", own(F.lit(parts)).alias("part"), "id", "v", of.alias("n")).withColumn("shard", every(F.col("n"))).drop("n")

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            q_ids, x = finite(left)
            ids, m = finite(right)
            block = max(1, PRODUCTS // max(1, len(ids)))
            for at in range(0, len(q_ids) if len(ids) else 0, block):
                few = q_ids[at : at + block]
                s = np.round(x[at : at + block] @ m.T, DIGITS)
                s[few[:, None] == ids[None, :]] = -np.inf
                row, score, target = largest(s, ids, k)
                out.append(pd.DataFrame({"query_id": few[row], "target_id": target, "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "target_id": [], "score": []})

        keys = ["cell", "shard", "part"]
        return ranked(q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(best, "query_id long, target_id long, score double"), k)


def rescore(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact scores of approximate candidates, ranked again."""
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    c = corpus.select(F.col("id").alias("target_id"), F.col("v").alias("tv"))
    rows = candidates.select("query_id", "target_id").distinct().join(q, "query_id").join(c, "target_id")
    return ranked(rows.select("query_id", "target_id", F.round(dot(F.col("qv"), F.col("tv")), DIGITS).alias("score")), k)


def char_grams(rows: DataFrame, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """(id, gram, tf): n-grams within words padded by a space; words shorter than n give themselves once."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return at if n == low else F.when(F.length(w) >= n, at).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in range(low, high + 1)])

    return rows.select("id", F.explode(F.flatten(F.transform(padded, grams))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def tfidf(grams: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, gram, w): sublinear tf times smooth idf, rows of unit length; grams without idf are dropped."""
    w = grams.join(idf, "gram").select("id", "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(F.col("id").alias("n_id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, F.col("id") == F.col("n_id")).select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def smooth_idf(grams: DataFrame, n_rows: int) -> DataFrame:
    return grams.groupBy("gram").agg((F.log((1.0 + n_rows) / (1.0 + F.count("*"))) + 1.0).alias("idf"))


def tfidf_search(queries: DataFrame, corpus: DataFrame, k: int, text: str = "name") -> DataFrame:
    """(query_id, target_id, score, rank) by cosine over an inverted index. Both: (id, text). Pairs are summed per gram, nothing is pruned."""
    grams = char_grams(corpus, text)
    idf = smooth_idf(grams, corpus.count())
    c = tfidf(grams, idf).select(F.col("id").alias("target_id"), "gram", F.col("w").alias("cw"))
    q = tfidf(char_grams(queries, text), idf).select(F.col("id").alias("query_id"), "gram", F.col("w").alias("qw"))
    pairs = q.join(c, "gram").groupBy("query_id", "target_id").agg(F.round(F.sum(F.col("qw") * F.col("cw")), DIGITS).alias("score"))
    return ranked(pairs, k)


def edit_rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, weight: float = 0.8, k: int | None = None, text: str = "name") -> DataFrame:
    """Scores mixed with edit similarity; ``weight`` (0 to 1) is the first score's."""
    from ..functions.text import edit_similarity

    weight = min(1.0, max(0.0, weight))
    q = queries.select(F.col("id").alias("query_id"), F.col(text).alias("q_text"))
    c = corpus.select(F.col("id").alias("target_id"), F.col(text).alias("c_text"))
    rows = hits.select("query_id", "target_id", F.col("score").alias("first_score")).join(q, "query_id").join(c, "target_id")
    mixed = weight * F.col("first_score") + (1 - weight) * edit_similarity(F.col("q_text"), F.col("c_text"))
    return ranked(rows.select("query_id", "target_id", "first_score", F.round(mixed, DIGITS).alias("score")), k)
