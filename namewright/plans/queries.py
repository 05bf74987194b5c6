"""Registered queries of the library's operators on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import reach_workers
from ..functions import text as T
from ..functions import udfs
from ..operators import corpus, decide, evaluate, rerank, retrieval
from ..sources import tables

POOL = 16
#: Of the 16 cells of ivf_rescore, those that a query searches: the recall of its 10 neighbours is at least 0.9 from 11 on.
PROBE = 12
#: Weights without the sequence ratio, which SQL can't repeat.
CORE = {k: v for k, v in rerank.CLOSED_SET.items() if k != "sequence_ratio"}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark, d):
    """Synonym table: brands as identifiers, part names as names."""
    return _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("cid"), F.col("p_name").alias("name"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.concat_ws("_", "label", (F.col("vec_id") % 3).cast("string")).alias("cid"))


def _variant():
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    swapped = F.concat(F.regexp_extract(n, "^([^ ]*) (.*)$", 2), F.lit(" "), F.regexp_extract(n, "^([^ ]*) (.*)$", 1))
    return F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.replace(n, F.lit(" "), F.lit("-"))).when(k == 3, F.concat_ws(" ", n, "p_type")).otherwise(swapped)


def _lab(spark, d):
    raw = _t(spark, d, "part").select(F.col("p_partkey").alias("query_i"), _variant().alias("metabolite_name"), F.col("p_name").alias("refmet_name"))
    return tables.lab(raw, dialect="n3")


def _targets(spark, d):
    names = _t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first")).select(F.col("p_name").alias("position"), F.col("p_name").alias("refmet_name"))
    return tables.targets(names, dialect="n3")


def _gold(spark, d):
    t = _targets(spark, d).select("target_id", F.col("refmet_normalized").alias("n"))
    rows = _lab(spark, d).join(t, F.col("refmet_normalized") == F.col("n"), "left")
    rows = decide.split_rows(rows, "query_i", F.col("target_id").isNotNull())
    return rows.select(F.col("query_i").alias("query_id"), "target_id", "split")


def _profiles(spark, d, dialect="A"):
    q = rerank.profile(_lab(spark, d), "query_i", "metabolite_normalized", "q", dialect)
    return q, rerank.profile(_targets(spark, d), "target_id", "refmet_normalized", "t", dialect)


def _neighbors(spark, d):
    """First-stage candidates: trigram similarity over an inverted index."""
    q, t = _profiles(spark, d)
    qs = q.select("q_id", "q_char3").groupBy("q_char3").agg(F.min("q_id").alias("rep"))
    a = qs.select("rep", F.size("q_char3").alias("nq"), F.explode("q_char3").alias("g"))
    b = t.select("t_id", F.size("t_char3").alias("nt"), F.explode("t_char3").alias("g"))
    common = a.join(b, "g").groupBy("rep", "t_id", "nq", "nt").agg(F.count("*").alias("c"))
    score = F.round(F.col("c") / (F.col("nq") + F.col("nt") - F.col("c")), retrieval.DIGITS)
    best = retrieval.ranked(common.select(F.col("rep").alias("query_id"), F.col("t_id").alias("target_id"), score.alias("score")), POOL)
    who = q.select("q_id", "q_char3").join(qs, "q_char3").select("q_id", "rep")
    return who.join(best.withColumnRenamed("query_id", "rep"), "rep").select(F.col("q_id").alias("query_id"), "target_id", "score", "rank")


def _features(spark, d, sequence=False, dialect="A"):
    q, t = _profiles(spark, d, dialect)
    return rerank.features(_neighbors(spark, d), q, t, dialect, sequence)


def _pred(spark, d, sequence=False):
    feats, base, gold = _features(spark, d, sequence), _neighbors(spark, d), _gold(spark, d)
    ranked = rerank.rerank(feats, rerank.CLOSED_SET if sequence else CORE)
    return rerank.predictions(ranked, gold, rerank.gold_ranks(ranked, base, gold))


POLICY = decide.Policy(least_score=0.30)


def retrieval_rows(spark, d):
    v = _vectors(spark, d)
    labels = tables.with_cid_size(v.select("id", "cid"))
    queries = v.filter("id % 4 = 0")
    hits = evaluate.relevance(retrieval.exact_neighbors(queries, v, 10), labels, 10)
    return evaluate.per_query(hits, labels.filter("id % 4 = 0"))


def retrieval_metrics(spark, d):
    return evaluate.retrieval_metrics(retrieval_rows(spark, d))


def retrieval_metrics_by_bucket(spark, d):
    return evaluate.bucket_metrics(retrieval_rows(spark, d))


def retrieval_ranks(spark, d):
    return retrieval_rows(spark, d).select("query_id", F.round("rr", 6).alias("rr"), "hit_10")


def exact_knn_topk(spark, d):
    v = _vectors(spark, d)
    return retrieval.exact_neighbors(v.filter("id % 4 = 0"), v, 10).select("query_id", "target_id", F.round("score", 6).alias("score"), "rank")


def ivf_rescore(spark, d):
    v = _vectors(spark, d)
    q = v.filter("id % 4 = 0")
    return retrieval.rescore(retrieval.InvertedFile(v).search(q, 20, PROBE), q, v, 10)


def hard_negatives_knn(spark, d):
    v = _vectors(spark, d)
    near = retrieval.exact_neighbors(v.filter("id % 4 = 0"), v, 50)
    cid = v.select("id", "cid")
    rows = near.join(cid.select(F.col("id").alias("query_id"), F.col("cid").alias("a")), "query_id").join(cid.select(F.col("id").alias("target_id"), F.col("cid").alias("b")), "target_id").filter("a <> b")
    return retrieval.ranked(rows.select("query_id", "target_id", F.round("score", 6).alias("score")), 3)


def synonym_table(spark, d):
    return tables.synonyms(_parts(spark, d), "n3").select("row_id", "cid", "name", "cid_size")


def synonym_summary(spark, d):
    return tables.describe(tables.synonyms(_parts(spark, d), "n3"))


def normalize_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace(T.normalize(F.col("text"), "n3"), "\\s+", " ").cast("binary")).alias("digest"))


def name_keys(spark, d):
    n = T.normalize(F.concat_ws(" ", "p_name", "p_type"), "n3")
    return _t(spark, d, "part").select("p_partkey", n.alias("norm"), T.compact(n).alias("compact"), F.array_join(F.sort_array(T.tokens(n)), "|").alias("tokens"), F.size(T.char3(n)).alias("n_char3"), T.hard_key_text(n).alias("hard_key"), T.hard_key(n)["length_bin"].alias("length_bin"), T.trainable(n).alias("trainable"), T.quality_score(n).alias("quality"))


def name_similarity(spark, d):
    a, b = T.normalize(F.col("p_name"), "n3"), T.normalize(F.concat_ws(" ", "p_name", "p_type"), "n3")
    return _t(spark, d, "part").select("p_partkey", F.round(T.jaccard(T.tokens(a), T.tokens(b)), 6).alias("token_jaccard"), F.round(T.jaccard(T.char3(a), T.char3(b)), 6).alias("char3_jaccard"), F.round(T.edit_similarity(a, b), 6).alias("edit"), T.surface_relation(a, b).alias("relation"))


def chemistry_signatures(spark, d):
    x = F.lower(F.concat(F.lit("PC("), "p_size", F.lit(":"), (F.col("p_size") % 7).cast("string"), F.lit(") cis-"), "p_name"))
    b = T.lipid_signature_b(x)
    return _t(spark, d, "part").select("p_partkey", T.lipid_signature_a(x).alias("lipid_a"), F.concat_ws("|", b["cls"], b["carbons"], b["bonds"]).alias("lipid_b"), T.lipid_class_a(x).alias("cls"), T.stereo_flag(x).alias("stereo_flag"), F.array_join(T.stereo_signature(x), "|").alias("stereo"), T.has_lipid(x).alias("has_lipid"), T.has_salt_form(F.col("p_type")).alias("salt"))


def name_variants(spark, d):
    n = F.concat(T.normalize(F.col("p_name"), "n3"), F.lit("*_"), F.col("p_size").cast("string"))
    return _t(spark, d, "part").select("p_partkey", F.explode(T.name_variants(n)).alias("v")).select("p_partkey", "v.method", "v.value")


def parse_identifiers(spark, d):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(".0|nan; "), F.col("p_size").cast("string"), F.lit(", "), F.col("p_partkey").cast("string"))
    return _t(spark, d, "part").select("p_partkey", T.cid_string(T.parse_cids(raw)).alias("cids"), T.size_bucket(F.col("p_size")).alias("bucket"))


def condense(spark, d):
    return corpus.condense(_parts(spark, d), 20)


def condense_summary(spark, d):
    return corpus.condensed_summary(corpus.condense(_parts(spark, d), 20))


def unique_surfaces(spark, d):
    return corpus.unique_surfaces(_parts(spark, d)).withColumn("candidate_cids", F.array_join("candidate_cids", "|"))


def surface_summary(spark, d):
    return corpus.surface_summary(corpus.unique_surfaces(_parts(spark, d)))


def global_surfaces(spark, d):
    return corpus.global_surfaces(corpus.condense(_parts(spark, d), 20))


def targeted_lookup(spark, d):
    wanted = _lab(spark, d).select(F.col("metabolite_normalized").alias("normalized_name"))
    return corpus.targeted_lookup(_parts(spark, d), wanted).withColumn("cids", F.array_join("cids", "|"))


def target_dictionary(spark, d):
    return _targets(spark, d).select("target_id", "refmet_name", "refmet_normalized", "refmet_compact")


def attached_cids(spark, d):
    look = corpus.targeted_lookup(_parts(spark, d), _targets(spark, d).select(F.col("refmet_normalized").alias("normalized_name")))
    return corpus.attach_cids(_targets(spark, d), look).select("target_id", F.array_join("refmet_cids", "|").alias("cids"))


def compact_key_matches(spark, d):
    s = _lab(spark, d).select(F.col("metabolite_name").alias("name"), F.lit("x").alias("cid"))
    return corpus.compact_matches(_targets(spark, d), corpus.unique_surfaces(s), 25).select("target_id", "normalized_name")


def best_mappings(spark, d):
    out = corpus.best_mappings(_targets(spark, d), corpus.unique_surfaces(_parts(spark, d)))
    return out.select("target_id", "method", F.array_join("cids", "|").alias("cids"), F.col("n_cids").cast("long").alias("n_cids"))


def mapping_status(spark, d):
    out = corpus.mapping_status(_lab(spark, d), corpus.unique_surfaces(_parts(spark, d)), ("metabolite_name", "refmet_name"))
    return out.groupBy("mapping_status").agg(F.count("*").alias("n"), F.sum("n_cids").alias("cids"))


def cid_groups(spark, d):
    return corpus.cid_groups(_parts(spark, d)).withColumn("names", F.array_join("names", "|"))


def hash_split(spark, d):
    return corpus.hash_split(_parts(spark, d), "cid", 0.2).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("cid").alias("cids"))


def hard_key_negatives(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("cid"), F.lower("p_name").alias("name"))
    return corpus.hard_negatives(rows, 2)


def surface_split(spark, d):
    return decide.sample_queries(_parts(spark, d), "row_id", 0.25).select("row_id")


def compound_split(spark, d):
    ids = decide.sample_queries(_parts(spark, d).select("cid").distinct(), "cid", 0.25)
    return _parts(spark, d).join(ids, "cid", "left_semi").select("row_id", "cid")


def lab_splits(spark, d):
    return _gold(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("target_id").alias("targets"))


def tfidf_search(spark, d):
    c = _targets(spark, d).select(F.col("target_id").alias("id"), F.col("refmet_normalized").alias("name"))
    q = _lab(spark, d).filter("query_i is not null").select(F.col("query_i").alias("id"), F.col("metabolite_normalized").alias("name"))
    hits = retrieval.tfidf_search(q, c, 5)
    return hits.select("query_id", "target_id", F.round("score", 6).alias("score"))


def tfidf_edit_rerank(spark, d):
    c = _targets(spark, d).select(F.col("target_id").alias("id"), F.col("refmet_normalized").alias("name"))
    q = _lab(spark, d).select(F.col("query_i").alias("id"), F.col("metabolite_normalized").alias("name"))
    return retrieval.edit_rerank(retrieval.tfidf_search(q, c, 15), q, c, 0.8, 5).select("query_id", "target_id", "rank", F.round("score", 6).alias("score"))


def features_core(spark, d):
    cols = ["rank_prior", "compact_exact", "char3_jaccard", "token_jaccard", "lipid_signature_match", "lipid_class_match", "stereo_mismatch"]
    return _features(spark, d).select("query_id", "target_id", "rank", *[F.round(c, 6).alias(c) for c in cols])


def rerank_core(spark, d):
    return rerank.rerank(_features(spark, d), CORE).filter("new_rank <= 5").select("query_id", "target_id", "new_rank", F.round("rerank_score", 6).alias("rerank_score"))


def rerank_full(spark, d):
    return rerank.rerank(_features(spark, d, True), rerank.CLOSED_SET).filter("new_rank <= 5").select("query_id", "target_id", "new_rank", "rerank_score")


def rerank_wide(spark, d):
    return rerank.wide_top(rerank.rerank(_features(spark, d, True), rerank.CLOSED_SET), _gold(spark, d), _targets(spark, d))


def gold_rank_fallback(spark, d):
    ranked = rerank.rerank(rerank.strict(_features(spark, d)), CORE)
    return rerank.gold_ranks(ranked, _neighbors(spark, d), _gold(spark, d)).select("query_id", "base_rank", "gold_rank")


def predictions_core(spark, d):
    return _pred(spark, d).select("query_id", "split", "predicted_target_id", F.round("prediction_score", 6).alias("prediction_score"), "top1_relation_to_query", "top1_exact_correct", "gold_rank")


def rank_metrics(spark, d):
    return evaluate.rank_metrics(_pred(spark, d), by=("split",))


def subset_metrics(spark, d):
    rows = _pred(spark, d)
    return evaluate.subset_metrics(rows, {"all": F.lit(True), "test": F.col("split") == "test", "wrong": ~F.col("top1_exact_correct")})


def auto_sweep(spark, d):
    return decide.auto_sweep(_pred(spark, d).filter("split = 'validation'"), POLICY)


def fallback_sweep(spark, d):
    return decide.fallback_sweep(_pred(spark, d).filter("split = 'validation'"), POLICY)


def _tiered(spark, d):
    pred = _pred(spark, d)
    limits = spark.createDataFrame([(0.02, 0.005)], "auto_threshold double, fallback_threshold double")
    return decide.assign_tiers(pred, "calibrated", POLICY, limits)


def confidence_tiers(spark, d):
    return decide.counts_within(_tiered(spark, d), "confidence_tier")


def calibrated_tiers(spark, d):
    return decide.counts_within(decide.assign_tiers(_pred(spark, d), "calibrated", POLICY), "confidence_tier")


def tier_diagnostics(spark, d):
    return decide.tier_diagnostics(_tiered(spark, d))


def curation_routes(spark, d):
    hit = _tiered(spark, d).filter("query_id % 2 = 0").select("query_id", F.lit(1).alias("fallback_target_id"), F.when(F.col("query_id") % 4 == 0, 0.9).otherwise(0.2).alias("fallback_score"))
    return decide.counts_within(decide.routes(_tiered(spark, d), hit, POLICY), "curation_route")


def curve_threshold(spark, d):
    return evaluate.curve_by_threshold(_pred(spark, d).filter("split = 'test'"))


def curve_coverage(spark, d):
    return evaluate.curve_by_coverage(_pred(spark, d).filter("split = 'test'"))


def case_groups(spark, d):
    return decide.counts_within(_pred(spark, d).withColumn("case_group", decide.case_group()), "case_group")


def review_sample(spark, d):
    rows = _pred(spark, d).filter("split = 'test'").withColumn("case_group", decide.case_group())
    return decide.stratified(rows, "case_group", {"top1_correct": 50}, [decide.seeded("query_id", 42), "query_id"], 75).select("query_id", "case_group", "review_rank")


def open_set(spark, d):
    gold = _gold(spark, d).filter("split = 'test'")
    held = decide.held_out_targets(gold)
    rows = gold.join(held, "target_id", "left_semi")
    feats = _features(spark, d).join(held, "target_id", "left_anti").join(rows.select("query_id"), "query_id", "left_semi")
    ranked = rerank.rerank(feats, CORE)
    return decide.open_set_sweep(rerank.predictions(ranked, rows, rerank.gold_ranks(ranked, _neighbors(spark, d), rows)), POLICY)


def strict_audit(spark, d):
    ranked = rerank.rerank(_features(spark, d), CORE)
    return evaluate.rank_metrics(evaluate.strict_ranks(ranked, _gold(spark, d)), "strict_rank", ks=(1, 5, 10))


def leakage_summary(spark, d):
    return evaluate.self_surface_audit(rerank.rerank(_features(spark, d), CORE), _gold(spark, d), _targets(spark, d))


def conservative_audit(spark, d):
    lab, t = _lab(spark, d), _targets(spark, d)
    rows = _pred(spark, d).join(lab.select(F.col("query_i").alias("query_id"), "metabolite_normalized", "refmet_normalized"), "query_id").join(t.select(F.col("target_id").alias("predicted_target_id"), F.col("refmet_normalized").alias("top1")), "predicted_target_id", "left")
    reason = evaluate.conservative_reason(F.col("metabolite_normalized"), F.col("refmet_normalized"), F.coalesce("top1", F.lit("")))
    return rows.withColumn("reason", F.coalesce(reason, F.lit("kept"))).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg(F.col("top1_exact_correct").cast("double")), 6).alias("accuracy"))


def ablation_core(spark, d):
    trials = rerank.ablations(CORE)
    ranks = rerank.trial_ranks(_features(spark, d), _neighbors(spark, d), _gold(spark, d), trials)
    return evaluate.rank_metrics(ranks, by=("trial",), ks=(1, 5, 10))


def weight_search(spark, d):
    trials = {f"trial_{i:03d}": w for i, w in enumerate(rerank.uniform_trials(240))}
    gold = _gold(spark, d).filter("split = 'validation'")
    feats = _features(spark, d, True).join(gold.select("query_id"), "query_id", "left_semi")
    return rerank.best_trial(rerank.trial_ranks(feats, _neighbors(spark, d), gold, trials))


def features_dialect_b(spark, d):
    return _features(spark, d, True, "B")


def identity_ranks(spark, d):
    t = corpus.attach_cids(_targets(spark, d), corpus.targeted_lookup(_parts(spark, d), _targets(spark, d).select(F.col("refmet_normalized").alias("normalized_name"))))
    return rerank.identity_ranks(rerank.rerank(_features(spark, d), CORE), _gold(spark, d), t)


def error_taxonomy(spark, d):
    t = corpus.attach_cids(_targets(spark, d), corpus.targeted_lookup(_parts(spark, d), _targets(spark, d).select(F.col("refmet_normalized").alias("normalized_name"))))
    gold, ranked = _gold(spark, d), rerank.rerank(_features(spark, d), CORE)
    ranks = rerank.identity_ranks(ranked, gold, t)
    q = _lab(spark, d).select(F.col("query_i").alias("query_id"), F.col("metabolite_normalized").alias("q"))
    name = lambda key, text, cids: t.select(F.col("target_id").alias(key), F.col("refmet_normalized").alias(text), F.col("refmet_cids").alias(cids))
    top = ranked.filter("new_rank = 1").select("query_id", F.col("target_id").alias("top_id"))
    rows = gold.select("query_id", F.col("target_id").alias("gold_id")).join(q, "query_id").join(top, "query_id").join(ranks, "query_id", "left")
    rows = rows.join(name("gold_id", "g", "g_cids"), "gold_id").join(name("top_id", "p", "p_cids"), "top_id")
    first = lambda rank: F.coalesce(F.col(rank) == 1, F.lit(False))
    rows = rows.select("query_id", "q", "g", "p", first("exact_rank").alias("exact_ok"), first("identity_rank").alias("identity_ok"), "exact_rank", "identity_rank", "g_cids", "p_cids")
    pairs = rows.select("g", "p").distinct().withColumn("ratio", udfs.sequence_ratio(F.col("g"), F.col("p"), 120))
    found = decide.taxonomy(rows.join(pairs, ["g", "p"]))
    total = Window.partitionBy()
    return found.groupBy("primary_category").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.avg(F.col("identity_ok").cast("double")), 6).alias("identity_rate")).withColumn(
        "share", F.round(F.col("n") / F.sum("n").over(total), 6)  # a row a category
    )


def partial_surface_audit(spark, d):
    lab = _lab(spark, d)
    pairs = lab.select(F.col("metabolite_normalized").alias("a"), F.col("refmet_normalized").alias("b")).distinct().withColumn("ratio", udfs.sequence_ratio(F.col("a"), F.col("b"), None))
    rows = pairs.withColumn("relation", T.partial_relation(F.col("a"), F.col("b"), F.col("ratio")))
    return rows.groupBy("relation").agg(F.count("*").alias("n"))


def bootstrap_ci(spark, d):
    return evaluate.bootstrap(evaluate.rank_components(_pred(spark, d).filter("split = 'test'")), ["mrr", "hit_1", "hit_10"], "query_id")


def paired_bootstrap(spark, d):
    gold = _gold(spark, d)
    ranks = rerank.trial_ranks(_features(spark, d), _neighbors(spark, d), gold, {"a": CORE, "b": {"embedding_score_norm": 1.0}})
    parts = evaluate.rank_components(ranks)
    wide = parts.groupBy("query_id").agg(*[(F.max(F.when(F.col("trial") == "a", F.col(m))) - F.max(F.when(F.col("trial") == "b", F.col(m)))).alias(m) for m in ("mrr", "hit_1")])
    return evaluate.bootstrap(wide, ["mrr", "hit_1"], "query_id")


def robustness_sweep(spark, d):
    c = _targets(spark, d).select(F.col("target_id").alias("id"), F.col("refmet_normalized").alias("name"))
    q = _lab(spark, d).select(F.col("query_i").alias("id"), F.col("refmet_normalized").alias("name"))
    hits = evaluate.robustness(q, lambda x: retrieval.tfidf_search(x, c, 10))
    gold = _gold(spark, d).select("query_id", F.col("target_id").alias("gold_id"))
    first = hits.join(gold, "query_id").groupBy("level", "query_id").agg(F.min(F.when(F.col("target_id") == F.col("gold_id"), F.col("rank"))).alias("gold_rank"))
    return evaluate.rank_metrics(first, by=("level",), ks=(1, 5, 10))


def triplets(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("cid"), F.lower("p_name").alias("name"))
    return corpus.triplets(rows)


def positive_pairs(spark, d):
    return corpus.positive_pairs(corpus.cid_groups(_parts(spark, d)))


def hashed_encoder_search(spark, d):
    c = _targets(spark, d).select(F.col("target_id").alias("id"), udfs.hashed_embedding(F.col("refmet_normalized")).alias("v"))
    q = _lab(spark, d).select((F.col("query_i") + 1_000_000_000).alias("id"), udfs.hashed_embedding(F.col("metabolite_normalized")).alias("v"))
    return retrieval.exact_neighbors(q, c, 5)


def event_windows(spark, d):
    from ..streaming import enrich

    return enrich.windowed_counts(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), width="1 day").groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_metrics, retrieval_metrics_by_bucket, retrieval_ranks, exact_knn_topk, ivf_rescore, hard_negatives_knn, synonym_table, synonym_summary, normalize_documents, name_keys, name_similarity,
        chemistry_signatures, name_variants, parse_identifiers, condense, condense_summary, unique_surfaces, surface_summary, global_surfaces, targeted_lookup, target_dictionary, attached_cids,
        compact_key_matches, best_mappings, mapping_status, cid_groups, hash_split, hard_key_negatives, surface_split, compound_split, lab_splits, tfidf_search, tfidf_edit_rerank, features_core,
        rerank_core, rerank_full, rerank_wide, gold_rank_fallback, predictions_core, rank_metrics, subset_metrics, auto_sweep, fallback_sweep, confidence_tiers, calibrated_tiers, tier_diagnostics,
        curation_routes, curve_threshold, curve_coverage, case_groups, review_sample, open_set, strict_audit, leakage_summary, conservative_audit, ablation_core, weight_search, features_dialect_b,
        identity_ranks, error_taxonomy, partial_surface_audit, bootstrap_ci, paired_bootstrap, robustness_sweep, triplets, positive_pairs, hashed_encoder_search, event_windows,
    )
}
