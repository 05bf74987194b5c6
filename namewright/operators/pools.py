"""Candidate pools of several sources, identifier lists, fallback comparison, review sheets, aligned tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rerank import FEATURES, linear_score
from .retrieval import DIGITS

#: Weights of the fixed hybrid of a pool's exact and scaled scores and text features.
POOL_WEIGHTS = {
    "score": 0.72,
    "scaled_score": 0.08,
    "sequence_ratio": 0.07,
    "char3_jaccard": 0.05,
    "token_jaccard": 0.03,
    "lipid_signature_match": 0.05,
    "lipid_class_match": 0.02,
    "normalized_exact": 0.04,
    "stereo_mismatch": -0.04,
}
#: Ranges of the random weights that a fallback's tuner tries.
FALLBACK_RANGES = {
    "embedding_score_norm": (0.20, 0.75),
    "rank_prior": (0.00, 0.08),
    "compact_exact": (0.00, 0.30),
    "sequence_ratio": (0.00, 0.35),
    "char3_jaccard": (0.00, 0.25),
    "token_jaccard": (0.00, 0.35),
    "lipid_signature_match": (0.00, 0.12),
    "lipid_class_match": (0.00, 0.10),
    "stereo_mismatch": (-0.18, 0.00),
}


def scaled(rows: DataFrame, by: tuple[str, ...] = ("query_id",), score: str = "score") -> DataFrame:
    """scaled_score: the score's place between the least and the largest of its query; a query of one score has 0."""
    own = Window.partitionBy(*by)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return rows.withColumn("scaled_score", (F.col(score) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)))


def pool(sources: dict[str, DataFrame], key: str = "target_id") -> DataFrame:
    """(query_id, target_id, score, rank, scaled_score, source) of all sources; a target of several counts for the first source that has it."""
    rows = None
    for i, (name, df) in enumerate(sources.items()):
        own = df.select("query_id", key, F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
        own = scaled(own).withColumn("source", F.lit(name)).withColumn("priority", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    first = Window.partitionBy("query_id", key).orderBy("priority", "rank")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "priority")


def pool_scores(pooled: DataFrame, feats: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """pooled with hybrid_score and new_rank; feats: features of its (query_id, target_id)."""
    weights = weights or POOL_WEIGHTS
    own = [k for k in weights if k not in ("score", "scaled_score")]
    rows = pooled.join(feats.select("query_id", "target_id", *own), ["query_id", "target_id"]).withColumn("hybrid_score", linear_score(weights))
    best = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "rank", "target_id")
    return rows.withColumn("new_rank", F.row_number().over(best))


def as_ranked(feats: DataFrame) -> DataFrame:
    """Features as if reranked by the first stage's own score, for predictions from it alone."""
    return feats.withColumn("rerank_score", F.round("score", DIGITS)).withColumn("new_rank", F.col("rank"))


def available_relevant(queries: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Of queries (query_id, cid, name): surfaces with its identifier, those of them that are its own name, and the others.

    surfaces: (normalized_name, cids array). The first count is a join on exploded lists, the second one on names with membership
    of the identifier as a condition, so both stay equi joins.
    """
    per_cid = surfaces.select(F.explode(F.array_distinct("cids")).alias("cid")).groupBy("cid").agg(F.count("*").alias("surfaces"))
    own = queries.join(surfaces, (F.col("name") == F.col("normalized_name")) & F.array_contains(F.col("cids"), F.col("cid"))).groupBy("query_id").agg(F.count("*").alias("exact"))
    rows = queries.join(per_cid, "cid", "left").join(own, "query_id", "left")
    n, e = F.coalesce("surfaces", F.lit(0)), F.coalesce("exact", F.lit(0))
    return rows.select("query_id", "cid", "name", n.alias("n_surfaces"), e.alias("n_exact"), F.greatest(n - e, F.lit(0)).alias("n_available"))


def nonexact_metrics(neighbors: DataFrame, available: DataFrame, surfaces: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row over queries with something to find: MRR, hits, precision and recall (of what is available) among neighbours of other names.

    neighbors: (query_id, target_id, rank); available: from ``available_relevant``; surfaces: (target_id, normalized_name, cids).
    """
    wanted = available.filter("n_available > 0")
    rows = neighbors.join(wanted, "query_id").join(surfaces, "target_id").filter("normalized_name <> name")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("hit", F.array_contains("cids", F.col("cid")))
    found = rows.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("r"))).alias("first"), *[F.count_if(F.col("hit") & (F.col("r") <= k)).alias(f"h{k}") for k in ks])
    per = wanted.join(found, "query_id", "left")
    mean = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(name)
    cols = [F.count("*").alias("n"), mean(1.0 / F.col("first"), "mrr")]
    for k in ks:
        h = F.col(f"h{k}")
        cols += [mean((h > 0).cast("double"), f"hit_{k}"), mean(h / k, f"precision_{k}"), mean(h / F.col("n_available"), f"recall_{k}")]
    return per.agg(*cols)


def fallback_cases(predictions: DataFrame, tier: str = "low_confidence_pubmed_fallback", beyond: int = 10) -> DataFrame:
    """Predictions of the lowest tier whose label has an identifier (has_cid) and isn't among the first ``beyond``."""
    return predictions.filter(F.col("has_cid") & (F.col("confidence_tier") == tier) & F.coalesce(F.col("gold_rank") > beyond, F.lit(True)))


def fallback_trials(base: dict[str, float], n: int = 120, seed: int = 42) -> dict[str, dict[str, float]]:
    """The first stage alone, the weights so far, and n random ones."""
    rng, out = random.Random(seed), {"embedding_only": {"embedding_score_norm": 1.0}, "refmet_weights": base}
    for i in range(n):
        out[f"random_{i:04d}"] = {k: rng.uniform(*FALLBACK_RANGES[k]) for k in FEATURES}
    return out


def same_cid_ranks(feats: DataFrame, wanted: DataFrame, cids: DataFrame, trials: dict[str, dict[str, float]]) -> DataFrame:
    """(trial, query_id, gold_rank) of each query's first candidate with one of its identifiers, for all weights in one job.

    wanted: (query_id, gold_cids array); cids: (target_id, cids array). null: no candidate has one.
    """
    names = list(trials)
    rows = feats.join(wanted, "query_id").join(cids, "target_id").withColumn("same", F.coalesce(F.arrays_overlap("gold_cids", "cids"), F.lit(False)))
    keys = list(dict.fromkeys(k for w in trials.values() for k in w))
    table = F.array(*[F.array(*[F.lit(float(trials[t].get(k, 0.0))) for k in keys]) for t in names])
    score = lambda w: F.round(sum((w[i] * F.col(k) for i, k in enumerate(keys)), F.lit(0.0)), DIGITS)
    rows = rows.select("query_id", "target_id", "rank", "same", F.posexplode(F.transform(table, score)).alias("i", "s"))
    best = Window.partitionBy("query_id", "i").orderBy(F.desc("s"), "rank", "target_id")
    found = rows.withColumn("r", F.row_number().over(best)).filter("same").groupBy("query_id", "i").agg(F.min("r").alias("gold_rank"))
    every = wanted.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i"))
    out = every.join(found, ["query_id", "i"], "left")
    return out.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("trial"), "query_id", "gold_rank")


def review_sheet(hits: DataFrame, pairs: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, top1 ... topN): names of candidates whose surface differs truly from the query's, of queries whose label's does.

    hits: (query_id, q_norm, t_norm, new_rank); pairs: (query_id, query, gold). A pivot by aggregates, in one pass.
    """
    differs = lambda a, b: T.surface_relation(a, b) == "different"
    queries = pairs.filter(differs(F.col("query"), F.col("gold"))).select("query_id")
    rows = hits.join(queries, "query_id", "left_semi").filter(differs(F.col("q_norm"), F.col("t_norm")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("new_rank"))).filter(F.col("r") <= n)
    return rows.groupBy("query_id").agg(*[F.max(F.when(F.col("r") == k, F.col("t_norm"))).alias(f"top{k}") for k in range(1, n + 1)])


def audit(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Rows and mean of a value for each group; groups of null are kept."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"))


def mean_pivot(rows: DataFrame, by: str, across: str, values: dict[str, str], value: str) -> DataFrame:
    """A column, named by ``values``, for each value of ``across``: the mean of ``value``; null where there is none."""
    return rows.groupBy(by).agg(*[F.round(F.avg(F.when(F.col(across) == v, F.col(value).cast("double"))), 6).alias(name) for v, name in values.items()])


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order; an aggregate, so rows of a hot key meet in part before the shuffle."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def upsert(rows: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """rows, with those of newer in place of rows of the same key."""
    return rows.join(newer.select(*keys).distinct(), keys, "left_anti").unionByName(newer)


def aligned(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Tables side by side on their keys; of columns of the same name the first stays. Rows are those of the first table."""
    out = None
    for df in tables.values():
        if out is None:
            out = df
        else:
            out = out.join(df.select(*keys, *[c for c in df.columns if c not in out.columns]), keys, "left")
    return out


def batch_ranks(pairs: DataFrame, batch: Column) -> DataFrame:
    """(pair_id, rank): of a pair (pair_id, a, p: vectors) one plus the batch's positives that score higher for its anchor.

    A batch is a bounded number of pairs, given by its expression.
    """
    rows = pairs.withColumn("batch", batch)
    dot = lambda x, y: F.round(F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda total, v: total + v), DIGITS)
    other = rows.select("batch", F.col("p").alias("q"))
    both = rows.withColumn("own", dot("a", "p")).join(other, "batch")
    return both.groupBy("pair_id").agg((F.count_if(dot("a", "q") > F.col("own")) + 1).alias("rank"))


def alignment(pairs: DataFrame) -> DataFrame:
    """One row: mean score of pairs (a, p), of the anchors with another text's vector (r), and the share of pairs that score higher."""
    dot = lambda x, y: F.round(F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda total, v: total + v), DIGITS)
    rows = pairs.select(dot("a", "p").alias("pos"), dot("a", "r").alias("neg"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("pos"), 6).alias("mean_positive"), F.round(F.avg("neg"), 6).alias("mean_random"), F.round(F.avg((F.col("pos") > F.col("neg")).cast("double")), 6).alias("positive_higher"))


def joined_lists(rows: DataFrame, key: str, lists: str, order: str) -> DataFrame:
    """(key, joined): distinct entries of lists (arrays) in the order in which they first occur."""
    each = rows.select(key, F.col(order).alias("o"), F.posexplode(lists).alias("i", "x")).groupBy(key, "x").agg(F.min(F.struct("o", "i")).alias("first"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "x"))), lambda s: s["x"]), "|").alias("joined"))


def numeric_join(values: Column) -> Column:
    """Distinct entries, numbers first by value, then other texts by code point."""
    keyed = F.transform(F.array_distinct(values), lambda x: F.struct((~x.rlike("^[0-9]+$")).alias("text"), F.when(x.rlike("^[0-9]+$"), x.cast("decimal(38,0)")).alias("number"), x.alias("x")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: s["x"]), "|")


def complete(rows: DataFrame, columns: list[str], label: str, without: str) -> DataFrame:
    """Rows whose columns are all there and whose label doesn't contain a word."""
    return rows.dropna(subset=columns).filter(~F.contains(F.lower(label), F.lit(without)))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a line number, before anything is cleaned."""
    return rows.orderBy(order).limit(n)
