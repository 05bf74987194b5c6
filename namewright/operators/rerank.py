"""Candidate features, linear reranking, ranks of the right label, predictions, weight search."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from .retrieval import DIGITS

FEATURES = ("embedding_score_norm", "rank_prior", "compact_exact", "sequence_ratio", "char3_jaccard", "token_jaccard", "lipid_signature_match", "lipid_class_match", "stereo_mismatch")
#: Tuned weights, of the closed label set.
CLOSED_SET = dict(zip(FEATURES, (0.6146199629957105, 0.001058188851763783, 0.0019459908649009634, 0.15473446059955223, 0.04851935434311621, 0.15534640024585533, 0.023706233573146503, 0.0000694085259543694, -0.06), strict=True))
#: Features in groups, for ablations.
DENSE = ("embedding_score_norm", "rank_prior")
EXACT = ("normalized_exact", "compact_exact")
SOFT = ("sequence_ratio", "char3_jaccard", "token_jaccard")
HINTS = ("lipid_signature_match", "lipid_class_match", "stereo_mismatch")


def profile(rows: DataFrame, id_col: str, norm: str, side: str, dialect: str = "A") -> DataFrame:
    """What features need of each distinct text, computed once a row and never a pair."""
    n = F.col(norm)
    cols = {"norm": n, "compact": T.compact(n), "char3": T.char3(n), "tokens": T.tokens(n)}
    if dialect == "A":
        cols |= {"lipid": T.lipid_signature_a(n), "cls": T.lipid_class_a(n), "stereo": T.stereo_flag(n)}
    else:
        cols |= {"lipid": T.lipid_signature_b(n), "stereo": T.stereo_signature(n)}
    return rows.select(F.col(id_col).alias(f"{side}_id"), *[c.alias(f"{side}_{k}") for k, c in cols.items()])


def features(neighbors: DataFrame, queries: DataFrame, targets: DataFrame, dialect: str = "A", sequence: bool = True) -> DataFrame:
    """neighbors (query_id, target_id, score, rank) with features; queries and targets as profiles q_*, t_*.

    Sequence ratios are computed for distinct pairs of texts. Without them the feature is 0.
    """
    f = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rows = neighbors.join(queries, F.col("query_id") == F.col("q_id")).join(targets, F.col("target_id") == F.col("t_id"))
    empty = 0.0 if dialect == "A" else 1.0
    cols = {
        "embedding_score_norm": (F.col("score") + 1.0) / 2.0,
        "rank_prior": 1.0 / F.col("rank"),
        "normalized_exact": f((F.col("q_norm") == F.col("t_norm")) & (F.col("q_norm") != "")),
        "compact_exact": f((F.col("q_compact") == F.col("t_compact")) & (F.col("q_compact") != "")),
        "char3_jaccard": T.jaccard(F.col("q_char3"), F.col("t_char3"), empty),
        "token_jaccard": T.jaccard(F.col("q_tokens"), F.col("t_tokens"), empty),
    }
    if dialect == "A":
        cols |= {
            "lipid_signature_match": f((F.col("q_lipid") != "") & (F.col("q_lipid") == F.col("t_lipid"))),
            "lipid_class_match": f((F.col("q_cls") != "") & (F.col("q_cls") == F.col("t_cls"))),
            "stereo_mismatch": f(F.col("q_stereo") != F.col("t_stereo")),
        }
    else:
        both = (F.size("q_stereo") > 0) & (F.size("t_stereo") > 0)
        cols |= {
            "lipid_signature_match": f(F.col("q_lipid") == F.col("t_lipid")),
            "lipid_class_match": f(F.col("q_lipid.cls") == F.col("t_lipid.cls")),
            "stereo_mismatch": f(both & (F.col("q_stereo") != F.col("t_stereo"))),
        }
    text = "compact" if dialect == "A" else "norm"
    keep = ["query_id", "target_id", "score", "rank", "q_norm", "t_norm", F.col(f"q_{text}").alias("q_text"), F.col(f"t_{text}").alias("t_text")]
    out = rows.select(*keep, *[c.alias(k) for k, c in cols.items()])
    if not sequence:
        return out.withColumn("sequence_ratio", F.lit(0.0)).drop("q_text", "t_text")
    pairs = out.select("q_text", "t_text").distinct()
    if dialect == "A":
        pairs = pairs.withColumn("sequence_ratio", udfs.sequence_ratio(F.col("q_text"), F.col("t_text"), 96))
    else:
        long = F.greatest(F.length("q_text"), F.length("t_text")) > 120
        grams = T.jaccard(T.char3(F.col("q_text")), T.char3(F.col("t_text")), 1.0)
        seq = udfs.sequence_ratio(F.when(~long, F.col("q_text")), F.when(~long, F.col("t_text")), None)
        pairs = pairs.withColumn("sequence_ratio", F.when(long, grams).otherwise(seq))
    return out.join(pairs, ["q_text", "t_text"]).drop("q_text", "t_text")


def linear_score(weights: dict[str, float]) -> Column:
    return F.round(sum((F.lit(float(w)) * F.col(k) for k, w in weights.items() if w), F.lit(0.0)), DIGITS)


def strict(feats: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """Without candidates whose surface is the query's, or whose target is held out."""
    rows = feats.filter("q_norm <> t_norm")
    return rows.join(held_out, "target_id", "left_anti") if held_out is not None else rows


def rerank(feats: DataFrame, weights: dict[str, float]) -> DataFrame:
    """new_rank by falling linear score, ties to the earlier rank, then the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "target_id")
    return feats.withColumn("rerank_score", linear_score(weights)).withColumn("new_rank", F.row_number().over(order))


def gold_ranks(ranked: DataFrame, base: DataFrame, gold: DataFrame, fall_back: bool = True) -> DataFrame:
    """(query_id, base_rank, gold_rank): null is not found. With ``fall_back`` a gold label that the reranked candidates lack keeps its first rank."""
    g = gold.select("query_id", F.col("target_id").alias("gold_id"))
    hit = lambda rows, rank, name: rows.join(g, "query_id").filter("target_id = gold_id").groupBy("query_id").agg(F.min(rank).alias(name))
    out = g.select("query_id").join(hit(base, "rank", "base_rank"), "query_id", "left").join(hit(ranked, "new_rank", "own_rank"), "query_id", "left")
    own = F.coalesce("own_rank", "base_rank") if fall_back else F.col("own_rank")
    return out.select("query_id", "base_rank", own.alias("gold_rank"))


def predictions(ranked: DataFrame, gold: DataFrame, ranks: DataFrame) -> DataFrame:
    """A row a query: predicted target, its score, the second's, margin, relation, correctness (only where a gold label is known), gold rank."""
    top = ranked.filter("new_rank <= 2").groupBy("query_id").agg(
        F.max_by("target_id", -F.col("new_rank")).alias("predicted_target_id"),
        F.max(F.when(F.col("new_rank") == 1, F.col("rerank_score"))).alias("prediction_score"),
        F.max(F.when(F.col("new_rank") == 2, F.col("rerank_score"))).alias("second_score"),
        F.max(F.when(F.col("new_rank") == 1, F.struct("q_norm", "t_norm"))).alias("x"),
    )
    rows = gold.select("query_id", F.col("target_id").alias("gold_id"), "split").join(top, "query_id", "left").join(ranks.select("query_id", "gold_rank"), "query_id", "left")
    return rows.select(
        "query_id",
        "split",
        "predicted_target_id",
        "prediction_score",
        "second_score",
        F.round(F.col("prediction_score") - F.col("second_score"), DIGITS).alias("score_margin"),
        F.coalesce(T.surface_relation(F.col("x.q_norm"), F.col("x.t_norm")), F.lit("different")).alias("top1_relation_to_query"),
        F.coalesce(F.col("predicted_target_id") == F.col("gold_id"), F.lit(False)).alias("top1_exact_correct"),
        "gold_rank",
    )


def wide_top(ranked: DataFrame, gold: DataFrame, names: DataFrame, n: int = 3) -> DataFrame:
    """top1_name, top1_score, top1_is_gold, ...: pivoted only here, at the sink."""
    rows = ranked.filter(F.col("new_rank") <= n).join(names.select("target_id", F.col("refmet_name").alias("name")), "target_id")
    rows = rows.join(gold.select("query_id", F.col("target_id").alias("gold_id")), "query_id", "left")
    cols = []
    for r in range(1, n + 1):
        at = lambda c, r=r: F.max(F.when(F.col("new_rank") == r, c))
        cols += [at(F.col("name")).alias(f"top{r}_name"), at(F.col("rerank_score")).alias(f"top{r}_score"), at(F.col("rank")).alias(f"top{r}_first_rank"), at(F.coalesce(F.col("target_id") == F.col("gold_id"), F.lit(False))).alias(f"top{r}_is_gold")]
    return rows.groupBy("query_id").agg(*cols)


def identity(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """(gold_id, target_id, reason) of distinct pairs that mean the same: exact_label, same_pubchem_cid, strong_alias."""
    t = targets.select("target_id", "refmet_cids", "refmet_normalized")
    g = t.select(F.col("target_id").alias("gold_id"), F.col("refmet_cids").alias("g_cids"), F.col("refmet_normalized").alias("g_norm"))
    rows = pairs.select("gold_id", "target_id").distinct().join(g, "gold_id").join(t, "target_id")
    ratio = udfs.sequence_ratio(F.col("g_norm"), F.col("refmet_normalized"), 120)
    reason = (
        F.when(F.col("gold_id") == F.col("target_id"), "exact_label")
        .when(T.cids_overlap(F.col("g_cids"), F.col("refmet_cids")), "same_pubchem_cid")
        .when(T.strong_alias(F.col("g_norm"), F.col("refmet_normalized"), F.col("ratio")), "strong_alias")
    )
    return rows.withColumn("ratio", ratio).select("gold_id", "target_id", reason.alias("reason")).filter("reason is not null")


def identity_ranks(ranked: DataFrame, gold: DataFrame, targets: DataFrame, rank: str = "new_rank") -> DataFrame:
    """(query_id, exact_rank, identity_rank, identity_reason)."""
    rows = ranked.select("query_id", "target_id", F.col(rank).alias("r")).join(gold.select("query_id", F.col("target_id").alias("gold_id")), "query_id")
    rows = rows.join(identity(rows, targets), ["gold_id", "target_id"], "left")
    return rows.groupBy("query_id").agg(
        F.min(F.when(F.col("gold_id") == F.col("target_id"), F.col("r"))).alias("exact_rank"),
        F.min(F.when(F.col("reason").isNotNull(), F.col("r"))).alias("identity_rank"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("r"))).alias("identity_reason"),
    )


def uniform_trials(n: int, seed: int = 42) -> list[dict[str, float]]:
    """The default weights and n random ones; ranges are fixed values."""
    ranges = ((0.35, 0.85), (0.0, 0.05), (0.0, 0.20), (0.0, 0.30), (0.0, 0.20), (0.0, 0.25), (0.0, 0.08), (0.0, 0.05), (-0.12, 0.0))
    rng = random.Random(seed)
    return [CLOSED_SET] + [{k: rng.uniform(*r) for k, r in zip(FEATURES, ranges, strict=True)} for _ in range(n)]


def dirichlet_trials(n: int, seed: int = 42, alpha: tuple[float, ...] = (8.0, 0.5, 0.8, 1.8, 0.8, 2.0, 0.7, 0.3), stereo: tuple[float, ...] = (0.0, 0.02, 0.04, 0.06)) -> list[dict[str, float]]:
    """Embedding alone, and n draws from a Dirichlet distribution with a stereo penalty."""
    rng, out = random.Random(seed), [{"embedding_score_norm": 1.0}]
    for _ in range(n):
        x = [rng.gammavariate(a, 1.0) for a in alpha]
        out.append({k: v / sum(x) for k, v in zip(FEATURES, x, strict=False)} | {"stereo_mismatch": -rng.choice(stereo)})
    return out


def ablations(base: dict[str, float]) -> dict[str, dict[str, float]]:
    """Nine systems that keep or drop groups of features."""
    only = lambda names: {k: v for k, v in base.items() if k in names}
    drop = lambda names: {k: v for k, v in base.items() if k not in names}
    return {
        "embedding_only": {"embedding_score_norm": 1.0},
        "exact_normalized_match_only": {"normalized_exact": 1.0, "compact_exact": 0.95, "rank_prior": 1e-4},
        "lexical_only_best_weights": only(EXACT + SOFT + HINTS),
        "dense_plus_exact": only(DENSE + EXACT),
        "dense_plus_soft_lexical": only((*DENSE, *SOFT, "stereo_mismatch")),
        "full_hybrid": base,
        "full_hybrid_minus_exact": drop(EXACT),
        "full_hybrid_minus_soft_lexical": drop(SOFT),
        "full_hybrid_minus_chem_hints": drop(HINTS),
    }


def trial_ranks(feats: DataFrame, base: DataFrame, gold: DataFrame, trials: dict[str, dict[str, float]]) -> DataFrame:
    """(trial, query_id, gold_rank) of all weight vectors in one job: the rank is one plus the candidates that beat the gold one.

    The scores of all trials are an array column made from a table of weights, so neither features nor shuffles are repeated a
    trial, and the generated code doesn't grow with their number.
    """
    names = list(trials)
    keys = list(dict.fromkeys(k for w in trials.values() for k in w))
    table = F.array(*[F.array(*[F.lit(float(trials[t].get(k, 0.0))) for k in keys]) for t in names])
    g = gold.select("query_id", F.col("target_id").alias("gold_id"))
    score = lambda w: F.round(sum((w[i] * F.col(k) for i, k in enumerate(keys)), F.lit(0.0)), DIGITS)
    scored = feats.join(g, "query_id").select("query_id", "target_id", "gold_id", "rank", F.transform(table, score).alias("s"))
    own = scored.filter("target_id = gold_id").groupBy("query_id").agg(F.min(F.struct("rank", "target_id", "s")).alias("own"))
    rows = scored.join(own, "query_id").withColumn("earlier", F.struct("rank", "target_id") < F.struct("own.rank", "own.target_id"))
    beats = F.transform("s", lambda x, i: (x > F.get("own.s", i)) | ((x == F.get("own.s", i)) & F.col("earlier")))
    found = rows.select("query_id", F.posexplode(beats).alias("i", "beats")).groupBy("query_id", "i").agg((F.count_if("beats") + 1).alias("r"))
    first = base.join(g, "query_id").filter("target_id = gold_id").groupBy("query_id").agg(F.min("rank").alias("base_rank"))
    every = g.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i"))
    out = every.join(found, ["query_id", "i"], "left").join(first, "query_id", "left")
    return out.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("trial"), "query_id", F.coalesce("r", "base_rank").alias("gold_rank"))


def best_trial(ranks: DataFrame) -> DataFrame:
    """MRR of each trial, best first; ties to the earlier name."""
    return ranks.groupBy("trial").agg(F.round(F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))), DIGITS).alias("mrr")).orderBy(F.desc("mrr"), "trial")
