"""Evaluation: retrieval and rank metrics, buckets, curves, bootstrap intervals, audits, robustness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import corruption

RETRIEVAL_KS, RANK_KS, ABLATION_KS = (1, 5, 10), (1, 5, 10, 50, 256), (1, 5, 10, 25, 50, 100, 256)


def relevance(neighbors: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Neighbours up to rank k without the query's own row, ranked anew, each with whether it shares the query's cid. labels: (id, cid, cid_size)."""
    q = labels.select(F.col("id").alias("query_id"), F.col("cid").alias("q_cid"), "cid_size")
    c = labels.select(F.col("id").alias("target_id"), F.col("cid").alias("c_cid"))
    rows = neighbors.filter("query_id <> target_id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("r") <= k)
    return rows.join(q, "query_id").join(c, "target_id").select("query_id", "target_id", "r", "cid_size", (F.col("q_cid") == F.col("c_cid")).alias("hit"))


def per_query(relevant: DataFrame, queries: DataFrame, ks: tuple[int, ...] = RETRIEVAL_KS) -> DataFrame:
    """Reciprocal rank within max(ks), hit, precision (over k) and recall (over cid_size - 1) of every query (id, cid_size), also those without neighbours."""
    hits = lambda k: F.count_if(F.col("hit") & (F.col("r") <= k))
    found = relevant.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("r"))).alias("first"), *[hits(k).alias(f"h{k}") for k in ks])
    rows = queries.select(F.col("id").alias("query_id"), "cid_size").join(found, "query_id", "left")
    out = [F.col("query_id"), F.col("cid_size"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        h = F.coalesce(f"h{k}", F.lit(0))
        out += [(h > 0).cast("double").alias(f"hit_{k}"), (h / k).alias(f"precision_{k}"), (h / F.greatest(F.col("cid_size") - 1, F.lit(1))).alias(f"recall_{k}")]
    return rows.select(*out)


def _means(ks: tuple[int, ...]) -> list[Column]:
    out = [F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr")]
    return out + [F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for k in ks for m in ("hit", "precision", "recall")]


def retrieval_metrics(rows: DataFrame, ks: tuple[int, ...] = RETRIEVAL_KS) -> DataFrame:
    return rows.agg(*_means(ks))


def bucket_metrics(rows: DataFrame, ks: tuple[int, ...] = RETRIEVAL_KS) -> DataFrame:
    """By synonym-set size, in the buckets' order; empty ones are left out."""
    out = rows.withColumn("bucket", T.size_bucket(F.col("cid_size"))).groupBy("bucket").agg(*_means(ks))
    return out.withColumn("bucket_order", F.array_position(F.array(*[F.lit(b) for b in T.BUCKET_ORDER]), F.col("bucket")).cast("int"))


def rank_metrics(rows: DataFrame, rank: str = "gold_rank", by: tuple[str, ...] = (), ks: tuple[int, ...] = RANK_KS) -> DataFrame:
    """n, MRR, hits at k, median of the ranks found; a null rank is a miss."""
    r = F.col(rank)
    cols = [F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr")]
    cols += [F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks]
    return rows.groupBy(*by).agg(*cols, F.percentile(rank, F.lit(0.5)).alias("median_rank"))


def subset_metrics(rows: DataFrame, subsets: dict[str, Column], rank: str = "gold_rank") -> DataFrame:
    """Rank metrics of overlapping subsets in one pass."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in subsets.items()]))
    return rank_metrics(rows.withColumn("subset", F.explode(named)), rank, ("subset",))


def threshold_grid(rows: DataFrame, column: str, points: int) -> DataFrame:
    """Distinct linear quantiles of a column at equally spaced points."""
    at = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    return rows.agg(F.percentile(column, at).alias("q")).select(F.explode(F.array_distinct(F.transform("q", lambda x: F.round(x, 9)))).alias("threshold")).filter("threshold is not null")


def swept(rows: DataFrame, grid: DataFrame, accept: Column, aggregates: list[Column]) -> DataFrame:
    """Aggregates over all rows for each threshold of a small grid; ``accept`` may use threshold. Each row meets each threshold in an aggregation that combines before the shuffle."""
    grid = grid.agg(F.collect_list("threshold").alias("grid"))  # points of the grid at most
    each = rows.join(F.broadcast(grid)).withColumn("threshold", F.explode("grid"))
    return each.withColumn("accepted", F.coalesce(accept, F.lit(False))).groupBy("threshold").agg(*aggregates)


def curve_by_threshold(pred: DataFrame, points: int = 41, least_score: float = 0.0) -> DataFrame:
    """Coverage and precision when margins from a threshold on are accepted."""
    grid = threshold_grid(pred.withColumn("m", F.coalesce("score_margin", F.lit(0.0))), "m", points)
    ok = (F.col("score_margin") >= F.col("threshold")) & (F.col("prediction_score") >= least_score)
    right = F.when(F.col("accepted"), F.col("top1_exact_correct").cast("double"))
    return swept(pred, grid, ok, [F.round(F.avg(F.col("accepted").cast("double")), 6).alias("coverage"), F.count_if("accepted").alias("accepted_n"), F.round(F.avg(right), 6).alias("precision")])


def curve_by_coverage(pred: DataFrame, levels: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1)) -> DataFrame:
    """Accuracy of the most confident share of rows, ties by query_id. Only counts by distinct margins are sorted together, then the rows of the margin at the cut."""
    m = F.round(F.coalesce("score_margin", F.lit(-1e9)), 9)
    rows = pred.select(m.alias("m"), "query_id", F.col("top1_exact_correct").cast("int").alias("ok"))
    n = rows.count()
    keep = {c: max(1, round(n * c)) for c in levels}
    by_margin = rows.groupBy("m").agg(F.count("*").alias("c"), F.sum("ok").alias("s"))
    upto = Window.orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    cum = by_margin.select("m", "c", (F.sum("c").over(upto) - F.col("c")).alias("before"), (F.sum("s").over(upto) - F.col("s")).alias("right"))
    cuts = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.lit(k).cast("long").alias("n_answered")) for c, k in keep.items()]))
    at = cum.select("*", cuts.alias("x")).select("*", "x.*").filter("before < n_answered and n_answered <= before + c").select(F.col("m").alias("cut"), "before", "right", "coverage", "n_answered")
    tied = rows.join(at.select("cut").distinct(), F.col("m") == F.col("cut"), "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("m").orderBy("query_id")))
    out = at.join(tied, (F.col("m") == F.col("cut")) & (F.col("nth") <= F.col("n_answered") - F.col("before")))
    out = out.groupBy("coverage", "n_answered", "cut", "right").agg(F.sum("ok").alias("more"))
    return out.select("coverage", "n_answered", F.round((F.col("right") + F.col("more")) / F.col("n_answered"), 6).alias("accuracy"), F.col("cut").alias("least_margin"))


def bootstrap(rows: DataFrame, values: list[str], key: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(metric, estimate, ci_low, ci_high, n) by Poisson resampling: a row's weight in a replicate comes from its key, so rows never gather.

    Each partition gives weighted sums of all replicates; for paired differences give columns of differences.
    """
    names = list(values)

    def sums(batches):
        total, weight = np.zeros((replicates, len(names))), np.zeros(replicates)
        for pdf in batches:
            x = pdf[names].to_numpy(np.float64)
            for k, v in zip(pdf["__k"].to_numpy(), x, strict=True):
                w = np.random.default_rng((seed, int(k) & 0xFFFFFFFF)).poisson(1.0, replicates)
                total += w[:, None] * v
                weight += w
        yield pd.DataFrame({"replicate": np.arange(replicates), "w": weight} | {f"s{i}": total[:, i] for i in range(len(names))})

    schema = "replicate long, w double, " + ", ".join(f"s{i} double" for i in range(len(names)))
    reps = rows.select(F.xxhash64(key).alias("__k"), *[F.col(v).cast("double").alias(v) for v in names]).mapInPandas(sums, schema).groupBy("replicate").agg(F.sum("w").alias("w"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))])
    reps = reps.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.try_divide(F.col(f"s{i}"), F.col("w")).alias("x")) for i, n in enumerate(names)])).alias("y")).select("y.*")
    ci = reps.groupBy("metric").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    est = rows.agg(F.count("*").alias("n"), *[F.avg(F.col(n).cast("double")).alias(n) for n in names])
    est = est.select("n", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("estimate")) for n in names])).alias("e")).select("n", "e.*")
    return est.join(ci, "metric").select("metric", "estimate", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n")


def rank_components(rows: DataFrame, rank: str = "gold_rank", ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    r = F.col(rank)
    return rows.withColumns({"mrr": F.coalesce(1.0 / r, F.lit(0.0))} | {f"hit_{k}": F.when(r <= k, 1.0).otherwise(0.0) for k in ks})


def self_surface_audit(ranked: DataFrame, gold: DataFrame, names: DataFrame, rank: str = "new_rank") -> DataFrame:
    """Leakage summary of queries whose gold surface differs: how often the query's own surface is a candidate. names: (target_id, refmet_normalized)."""
    g = gold.join(names.select(F.col("target_id").alias("g"), F.col("refmet_normalized").alias("g_norm")), F.col("target_id") == F.col("g")).select("query_id", "g_norm")
    own = ranked.groupBy("query_id").agg(F.bool_or(F.col("q_norm") == F.col("t_norm")).alias("own_in_pool"), F.bool_or((F.col("q_norm") == F.col("t_norm")) & (F.col(rank) == 1)).alias("own_first"), F.min("q_norm").alias("q"))
    rows = g.join(own, "query_id", "left").withColumn("same", F.coalesce(F.col("q") == F.col("g_norm"), F.lit(False)))
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.agg(
        F.count("*").alias("queries"),
        F.count_if("same").alias("gold_equals_query"),
        F.count_if(no(F.col("own_first"))).alias("top1_equals_query"),
        F.count_if(~F.col("same") & no(F.col("own_first"))).alias("nonidentical_top1_equals_query"),
        F.count_if(~F.col("same")).alias("nonidentical"),
        F.count_if(~F.col("same") & no(F.col("own_in_pool"))).alias("nonidentical_own_in_pool"),
    )


def strict_ranks(ranked: DataFrame, gold: DataFrame, rank: str = "new_rank") -> DataFrame:
    """Gold ranks after candidates with the query's surface are removed and the rest is counted anew."""
    rows = ranked.filter("q_norm <> t_norm").withColumn("strict_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(rank)))
    g = gold.select("query_id", F.col("target_id").alias("gold_id"))
    hit = rows.join(g, "query_id").filter("target_id = gold_id").groupBy("query_id").agg(F.min("strict_rank").alias("strict_rank"))
    return g.select("query_id").join(hit, "query_id", "left")


def conservative_reason(query: Column, gold: Column, top1: Column) -> Column:
    """Why a conservative audit leaves a row out; null keeps it."""
    return F.when((query == gold) & (query == top1), "gold_and_top1_equal_query").when(query == gold, "gold_equals_query").when(query == top1, "top1_equals_query")


def robustness(queries: DataFrame, search, levels: tuple[float, ...] = (0.0, 0.1, 0.3), seed: int = 42) -> DataFrame:
    """(level, query_id, ...) of ``search(queries)`` over corrupted texts of each level; the corpus stays. queries: (id, name)."""
    out = None
    for i, level in enumerate(levels):
        bad = queries.withColumn("name", corruption.corrupt(F.col("name"), F.col("id"), level, seed + i + 1000))
        rows = search(bad).withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


def examples(relevant: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """The first k neighbours of n queries, in md5 order (a report)."""
    few = queries.select("id").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(n)
    return relevant.filter(F.col("r") <= k).join(few, F.col("query_id") == F.col("id"), "left_semi")
