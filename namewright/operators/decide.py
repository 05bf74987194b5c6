"""Decisions: splits, samples, calibrated thresholds, confidence tiers, curation routes, case groups, error taxonomy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import swept, threshold_grid

HIGH, MEDIUM, LOW = "high_confidence_refmet_auto_accept", "medium_confidence_refmet_review", "low_confidence_pubmed_fallback"


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_queries(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """About that share of rows, exactly bround(n * fraction), at least one: the first in seeded md5 order. The cut is found among distinct 16-bit prefixes first."""
    n = rows.count()
    want = min(n, max(1, int(_half_even(n * fraction)))) if n else 0
    keyed = rows.withColumns({"__h": seeded(key, seed)}).withColumn("__p", F.substring("__h", 1, 4))
    by = keyed.groupBy("__p").agg(F.count("*").alias("c"))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    cut = by.withColumn("cum", F.sum("c").over(upto)).filter(F.col("cum") >= want).orderBy("__p").select("__p", (F.col("cum") - F.col("c")).alias("before")).first()
    if not cut:
        return rows.limit(0)
    edge = keyed.filter(F.col("__p") == cut["__p"]).withColumn("__r", F.row_number().over(Window.orderBy("__h", key))).filter(F.col("__r") <= want - cut["before"])
    return keyed.filter(F.col("__p") < cut["__p"]).drop("__h", "__p").unionByName(edge.drop("__h", "__p", "__r"))


def _half_even(x: float) -> float:
    return round(x)


def split_rows(rows: DataFrame, key: str, labelled: Column, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """train, validation or test by md5 of the key; rows without a usable label are unlabeled_or_unmapped."""
    v = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") / 4294967296.0
    return rows.withColumn("split", F.when(~F.coalesce(labelled, F.lit(False)), "unlabeled_or_unmapped").when(v < train, "train").when(v < train + validation, "validation").otherwise("test"))


def stratified(rows: DataFrame, stratum: str, quotas: dict[str, int], order: list, default: int = 0) -> DataFrame:
    """Up to a quota of rows of each stratum, first by ``order`` (a review sheet)."""
    quota = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(n)) for s, n in quotas.items()], F.lit(default))
    ranked = rows.withColumn("review_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.filter(F.col("review_rank") <= quota)


@dataclass(frozen=True)
class Policy:
    """Fixed values of the decision rules."""

    least_score: float = 0.45
    high_margin: float = 0.0638
    low_margin: float = 0.0031
    supported_margin: float = 0.0283
    auto_precision: float = 0.90
    fallback_hit10: float = 0.80
    fallback_score: float = 0.70


def supported() -> Column:
    return F.col("top1_relation_to_query").isin(*T.SUPPORTED)


def _score() -> Column:
    return F.coalesce("prediction_score", F.lit(float("-inf")))


def _margin() -> Column:
    return F.coalesce("score_margin", F.lit(float("-inf")))


def auto_sweep(pred: DataFrame, policy: Policy = Policy(), points: int = 101) -> DataFrame:
    """Of each margin threshold: rows accepted, their precision, coverage."""
    ok = (_score() >= policy.least_score) & ((_margin() >= F.col("threshold")) | ((_margin() >= policy.supported_margin) & supported()))
    right = F.when(F.col("accepted"), F.col("top1_exact_correct").cast("double"))
    out = swept(pred, threshold_grid(pred, "score_margin", points), ok, [F.count_if("accepted").alias("accepted_n"), F.round(F.avg(right), 6).alias("precision"), F.round(F.avg(F.col("accepted").cast("double")), 6).alias("coverage")])
    return out.filter("accepted_n > 0")


def fallback_sweep(pred: DataFrame, policy: Policy = Policy(), points: int = 101) -> DataFrame:
    """Of each margin threshold: rows retained and sent to the fallback, and how often their gold label is in the first ten."""
    ok = (_score() >= policy.least_score) & (_margin() >= F.col("threshold"))
    in10 = F.coalesce(F.col("gold_rank") <= 10, F.lit(False)).cast("double")
    a = F.col("accepted")
    return swept(
        pred,
        threshold_grid(pred, "score_margin", points),
        ok,
        [
            F.count_if(a).alias("retained_n"),
            F.round(F.avg(F.when(a, in10)), 6).alias("retained_hit10"),
            F.round(F.avg(a.cast("double")), 6).alias("retained_coverage"),
            F.count_if(~a).alias("fallback_n"),
            F.round(F.avg(F.when(~a, in10)), 6).alias("fallback_hit10"),
        ],
    )


def calibrate(validation: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row, auto_threshold and fallback_threshold: the widest coverage that reaches the goal, of ties the lowest threshold; else the best goal."""
    t = -F.col("threshold")
    a = auto_sweep(validation, policy).agg(
        F.max(F.when(F.col("precision") >= policy.auto_precision, F.struct(F.col("coverage"), t.alias("t")))).alias("good"),
        F.max(F.struct("precision", "coverage", t.alias("t"))).alias("best"),
    )
    f = fallback_sweep(validation, policy).filter("retained_n > 0").agg(
        F.max(F.when(F.col("retained_hit10") >= policy.fallback_hit10, F.struct(F.col("retained_coverage").alias("c"), t.alias("t")))).alias("f_good"),
        F.max(F.struct("retained_hit10", "retained_coverage", t.alias("t"))).alias("f_best"),
    )
    return a.crossJoin(f).select(  # one row each
        F.coalesce(-F.coalesce("good.t", "best.t"), F.lit(policy.high_margin)).alias("auto_threshold"),
        F.coalesce(-F.coalesce("f_good.t", "f_best.t"), F.lit(policy.low_margin)).alias("fallback_threshold"),
    )


MODES = {"calibrated": "calibrated", "threshold": "calibrated", "threshold_calibrated": "calibrated", "low_confidence": "low", "low_conf": "low", "review_only": "review", "uncertain": "review", "manual_review": "review", "all": "all"}


def assign_tiers(pred: DataFrame, mode: str = "calibrated", policy: Policy = Policy(), thresholds: DataFrame | None = None) -> DataFrame:
    """pred with confidence_tier. Thresholds (one row) are given, or calibrated on the validation split."""
    kind = MODES.get(mode.lower().strip())
    if kind is None:
        raise ValueError(f"unknown mode: {mode}")
    if kind == "all":
        return pred.withColumn("confidence_tier", F.lit(LOW))
    if kind == "calibrated":
        given = thresholds if thresholds is not None else calibrate(pred.filter("split = 'validation'"), policy)
        rows, auto = pred.join(F.broadcast(given)), F.col("auto_threshold")  # one row
    else:
        rows, auto = pred, F.lit(policy.high_margin)
    high = (_score() >= policy.least_score) & ((_margin() >= auto) | ((_margin() >= policy.supported_margin) & supported()))
    low = {"calibrated": lambda: (_margin() < F.col("fallback_threshold")) | (_score() < policy.least_score), "low": lambda: (_margin() <= policy.low_margin) | (_score() < policy.least_score), "review": lambda: F.lit(True)}[kind]()
    return rows.withColumn("confidence_tier", F.when(high, HIGH).when(low, LOW).otherwise(MEDIUM)).drop("auto_threshold", "fallback_threshold")


def fallback_queries(pred: DataFrame, mode: str = "calibrated") -> DataFrame:
    kind = MODES[mode.lower().strip()]
    keep = {"all": F.lit(True), "review": F.col("confidence_tier") != HIGH}.get(kind, F.col("confidence_tier") == LOW)
    return pred.filter(keep).select("query_id").distinct()


def routes(pred: DataFrame, fallback: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """pred with its best fallback hit (query_id, fallback_target_id, fallback_score) and curation_route."""
    out = pred.join(fallback, "query_id", "left")
    tier = F.col("confidence_tier")
    route = (
        F.when(tier == HIGH, "existing_refmet_auto_accept")
        .when(tier == MEDIUM, MEDIUM)
        .when((tier == LOW) & (F.col("fallback_score") >= policy.fallback_score), "manual_review_possible_new_refmet_or_pubchem_candidate")
        .when(tier == LOW, "manual_review_low_confidence_no_pubmed_candidate")
        .otherwise("manual_review_uncategorized")
    )
    return out.withColumn("curation_route", route)


def counts_within(rows: DataFrame, group: str, within: str = "split") -> DataFrame:
    """Counts of a group and their share within a split."""
    n = rows.groupBy(within, group).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(within)), 6))


def tier_diagnostics(pred: DataFrame) -> DataFrame:
    r = F.col("gold_rank")
    hit = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    return pred.groupBy("split", "confidence_tier").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"),
        hit(1),
        hit(10),
        hit(256),
        F.percentile("gold_rank", F.lit(0.5)).alias("median_rank"),
        F.round(F.avg("score_margin"), 6).alias("mean_margin"),
        F.round(F.percentile("score_margin", F.lit(0.5)), 6).alias("median_margin"),
    )


def case_group() -> Column:
    r = F.col("gold_rank")
    return F.when(F.col("top1_exact_correct"), "top1_correct").when(r <= 10, "gold_in_top10_not_rank1").when(r <= 256, "gold_in_top256_not_top10").otherwise("gold_not_retrieved_top256")


def open_set_sweep(pred: DataFrame, policy: Policy = Policy(), points: int = 31) -> DataFrame:
    """False accepts of queries whose label was held out, by margin threshold."""
    grid = threshold_grid(pred.withColumn("m", F.coalesce("score_margin", F.lit(0.0))), "m", points)
    ok = (F.col("score_margin") >= F.col("threshold")) & (F.col("prediction_score") >= policy.least_score)
    a = F.col("accepted").cast("double")
    return swept(pred, grid, ok, [F.count("*").alias("n_open"), F.round(F.avg(a), 6).alias("false_accept_rate"), F.round(F.avg(1 - a), 6).alias("abstain_rate")])


def held_out_targets(gold: DataFrame, fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """About that share of the targets that occur, at least one: int(n * fraction) first in md5 order."""
    ids = gold.select("target_id").distinct()
    n = max(1, int(ids.count() * fraction))
    return ids.orderBy(seeded("target_id", seed), "target_id").limit(n)


def taxonomy(rows: DataFrame) -> DataFrame:
    """Error categories of predictions, the first that isn't a success as the primary one.

    rows: query_id, q, g, p (normalised query, gold and predicted names), exact_ok, identity_ok, exact_rank, identity_rank,
    g_cids, p_cids, ratio (sequence ratio of g and p).
    """
    q, g, p = F.col("q"), F.col("g"), F.col("p")
    ok, same = F.col("exact_ok"), F.col("identity_ok")
    sq, sg, sp = (T.stereo_tokens(c) for c in (q, g, p))
    hq, hg, hp = (T.has_salt_form(c) for c in (q, g, p))
    tq, tg, tp = (T.tokens(c) for c in (q, g, p))
    common = F.size(F.array_intersect(tq, tg))
    subset = (F.size(tq) > 0) & (F.size(tg) > 0) & (F.size(tq) != F.size(tg)) & (common == F.least(F.size(tq), F.size(tg)))
    rank_error = (
        F.when(~ok & F.col("exact_rank").between(2, 10), "reranking_error_gold_in_top10")
        .when(~same & F.col("identity_rank").between(2, 10), "reranking_error_identity_in_top10")
        .when(~ok & (F.col("exact_rank").isNull() | (F.col("exact_rank") > 10)), "candidate_generation_miss_or_low_rank")
    )
    near = (F.col("ratio") >= 0.70) | (T.jaccard(T.char3(g), T.char3(p), 1.0) >= 0.55) | (T.jaccard(tg, tp, 1.0) >= 0.50)
    found = F.array_compact(
        F.array(
            F.when(ok, "success_exact_top1").when(same, "identity_match_not_exact_label"),
            rank_error,
            F.when((F.size("g_cids") == 0) | (F.size("p_cids") == 0), "reference_label_limitation"),
            F.when((T.compact(g) == T.compact(p)) & (g != p), "formatting_only_mismatch"),
            F.when(((F.size(sq) > 0) | (F.size(sg) > 0) | (F.size(sp) > 0)) & (sg != sp), "stereochemistry_confusion"),
            F.when((hq | hg | hp) & ((hg != hp) | hq), "salt_adduct_form_confusion"),
            F.when(T.has_lipid(q) | T.has_lipid(g) | T.has_lipid(p), "lipid_shorthand_ambiguity"),
            F.when(T.abbreviation_like(q) | T.abbreviation_like(g) | T.abbreviation_like(p), "abbreviation_ambiguity"),
            F.when(subset, "token_omission"),
            F.when(~same & near, "near_isomer_or_near_neighbor_confusion"),
        )
    )
    found = F.when(F.size(found) == 0, F.array(F.lit("unclassified_needs_manual_review"))).otherwise(found)
    failing = F.filter("categories", lambda c: ~F.startswith(c, F.lit("success")))
    return rows.withColumn("categories", found).withColumn("primary_category", F.coalesce(F.get(failing, 0), F.get("categories", 0)))
