"""Metrics, invariants and scale paths of the name-resolution operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.operators import corpus, decide, evaluate, rerank, retrieval
from namewright.sources import tables
from namewright.streaming import enrich


def test_rank_metrics(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (10,)], "gold_rank int")
    r = evaluate.rank_metrics(df).first()
    assert (r.n, r.mrr, r.hit_1, r.hit_5, r.hit_10, r.median_rank) == (4, 0.4, 0.25, 0.5, 0.75, 2.0)


def test_retrieval_metrics_of_one_query(spark):
    rel = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)], "query_id long, r int, hit boolean")
    q = spark.createDataFrame([(1, 3)], "id long, cid_size int")
    r = evaluate.per_query(rel, q, (1, 5)).first()
    assert (r.rr, r.hit_1, r.hit_5, r.precision_5, r.recall_5) == (0.5, 0.0, 1.0, 0.4, 1.0)


def vectors(spark, n=300, dim=8):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_exact_neighbors_match_numpy_in_any_partitioning(spark):
    x, df = vectors(spark)
    want = {(q, int(t)) for q in range(20) for t in [i for i in np.argsort(-np.round(x @ x[q], 9), kind="stable") if i != q][:5]}
    for parts in (1, 7):
        got = retrieval.exact_neighbors(df.filter("id < 20").repartition(parts), df.repartition(parts), 5, block=6, shard=20, part=7)
        assert {(r.query_id, r.target_id) for r in got.collect()} == want


def test_inverted_file_recall(spark):
    x, df = vectors(spark, 400)
    q = df.filter("id < 40")
    exact = {(r.query_id, r.target_id) for r in retrieval.exact_neighbors(q, df, 5).collect()}
    index = retrieval.InvertedFile(df, cells=8)
    near = {(r.query_id, r.target_id) for r in retrieval.rescore(index.search(q, 20, 6), q, df, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert {(r.query_id, r.target_id) for r in index.search(q, 5, 8).collect()} == exact


def test_inverted_file_search_makes_no_row_a_pair(spark):
    x, _ = vectors(spark, 120)
    x = np.concatenate([x, np.repeat(x[:1], 40, 0)])  # a cell of many copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 8)], "id long, v array<double>")
    df = rows.filter("id < 500")
    index = retrieval.InvertedFile(df, cells=6)
    plan = index.search(df, 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    near = lambda n: np.argsort((index.centroids**2).sum(1) - 2 * x @ index.centroids.T, axis=1, kind="stable")[:, :n]
    cell, probed, s = near(1)[:, 0], near(3), np.round(x @ x.T, 9)
    of = lambda q: [j for j in np.lexsort((np.arange(len(x)), -s[q])) if j != q and cell[j] in probed[q]][:5]
    want = {(q, r): int(t) for q in range(len(x)) for r, t in enumerate(of(q), 1)}
    index.corpus = rows
    for parts in (1, 7):
        got = index.search(rows.repartition(parts), 5, 3, shard=9, part=50).collect()
        assert {(r.query_id, r["rank"]): r.target_id for r in got} == want and len(got) == len(want)
    assert index.search(df.filter("id < 0"), 5, 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ivf_rescore_recall_at_its_own_settings(spark, sf):
    from namewright.plans import queries

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    exact = {(int(ids[i]), int(t)) for i in np.flatnonzero(ids % 4 == 0) for t in [ids[j] for j in np.lexsort((ids, -np.round(x @ x[i], 9))) if j != i][:10]}
    got = {(r.query_id, r.target_id) for r in queries.ivf_rescore(spark, d).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_mapping_status_broadcasts_no_side_that_grows_with_the_corpus(spark, tmp_path):
    names = spark.range(5000).select(F.col("id").alias("query_i"), F.concat(F.lit("n"), F.col("id") % 10).alias("name"))
    names.union(spark.createDataFrame([(7, "n8"), (None, "n1")], "query_i long, name string")).write.parquet(f"{tmp_path}/lab")
    spark.createDataFrame([(f"c{i}", f"N{k}") for k in range(1, 9) for i in range(k)], "cid string, name string").write.parquet(f"{tmp_path}/raw")
    lab = spark.read.parquet(f"{tmp_path}/lab").withColumn("other", F.lit(""))
    out = corpus.mapping_status(lab, corpus.unique_surfaces(spark.read.parquet(f"{tmp_path}/raw")), ("name", "other"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.query_i, []).append((r.n_cids, r.mapping_status))
    status = ["unmatched", "exact_unique_cid", *["exact_ambiguous_cid"] * 7]
    want = {i: [(n, status[n])] for i in range(5000) for n in [i % 10 if i % 10 < 9 else 0]} | {7: [(8, status[8])] * 2, None: [(0, "unmatched")]}
    assert got == want


def test_numbered_by_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert [(r.k, r.n) for r in tables.numbered_by(df, "k", "n").orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_hard_negatives_are_the_first_of_another_cid(spark):
    rows = [(i, f"c{i % 3}", "abcd xy") for i in range(12)] + [(50, "c9", "lonely")]
    got = {(r.row_id, r["rank"]): r.negative_id for r in corpus.hard_negatives(spark.createDataFrame(rows, "row_id long, cid string, name string"), 2).collect()}
    import hashlib

    order = sorted(range(12), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    for i in range(12):
        assert [got[i, 1], got[i, 2]] == [j for j in order if j % 3 != i % 3][:2]
    assert (50, 1) not in got


def predictions(spark):
    rows = [(i, "validation" if i % 2 else "test", 1, 0.4 + (i % 50) / 100, 0.1, round((i % 40) / 400, 4), ["different", "substring"][i % 2], i % 3 > 0, [1, 4, 30, None][i % 4]) for i in range(400)]
    return spark.createDataFrame(rows, "query_id long, split string, predicted_target_id long, prediction_score double, second_score double, score_margin double, top1_relation_to_query string, top1_exact_correct boolean, gold_rank int")


def test_sweeps_partition_the_rows(spark):
    pred = predictions(spark)
    assert all(r.retained_n + r.fallback_n == 400 for r in decide.fallback_sweep(pred).collect())
    tiers = decide.counts_within(decide.assign_tiers(pred), "confidence_tier").collect()
    for split in ("test", "validation"):
        assert sum(r.fraction for r in tiers if r.split == split) == pytest.approx(1.0, abs=1e-5)


@pytest.mark.parametrize("mode", ["low_confidence", "review_only", "all", "calibrated"])
def test_tier_modes(spark, mode):
    out = decide.assign_tiers(predictions(spark), mode)
    assert out.filter(F.col("confidence_tier").isNull()).count() == 0 and out.count() == 400
    assert decide.fallback_queries(out, mode).count() == out.filter(f"confidence_tier {'is not null' if mode == 'all' else repr(decide.LOW).join(['= ', ''])}").count()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        decide.assign_tiers(predictions(spark), "sometimes")


def test_coverage_curve_matches_sorting(spark):
    pred = predictions(spark)
    rows = sorted(((-r.score_margin, r.query_id, r.top1_exact_correct) for r in pred.collect()))
    for r in evaluate.curve_by_coverage(pred).collect():
        n = max(1, round(400 * r.coverage))
        assert r.n_answered == n and r.accuracy == pytest.approx(sum(x[2] for x in rows[:n]) / n, abs=1e-6)


def test_bootstrap_covers_the_estimate(spark):
    rows = evaluate.rank_components(predictions(spark))
    a = evaluate.bootstrap(rows.repartition(2), ["mrr", "hit_1"], "query_id").collect()
    b = evaluate.bootstrap(rows.repartition(5), ["mrr", "hit_1"], "query_id").collect()
    for x in a:
        y = next(y for y in b if y.metric == x.metric)
        assert x.ci_low < x.estimate < x.ci_high and x.n == 400 and x.ci_low == pytest.approx(y.ci_low) and x.ci_high == pytest.approx(y.ci_high)


def test_sample_queries_has_the_exact_size(spark):
    df = spark.range(1003)
    got = decide.sample_queries(df.repartition(6), "id", 0.25)
    assert got.count() == round(1003 * 0.25) and got.exceptAll(decide.sample_queries(df, "id", 0.25)).count() == 0
    assert decide.sample_queries(df.limit(0), "id", 0.25).count() == 0 and decide.sample_queries(df.limit(3), "id", 0.01).count() == 1


def test_trials_agree_with_reranking(spark):
    rng = np.random.default_rng(1)
    rows = [(q, t, float(rng.random()), t + 1, float(rng.random()), float(rng.random())) for q in range(30) for t in range(6)]
    feats = spark.createDataFrame(rows, "query_id long, target_id long, score double, rank int, embedding_score_norm double, char3_jaccard double")
    gold = spark.createDataFrame([(q, q % 7, "test") for q in range(30)], "query_id long, target_id long, split string")
    w = {"embedding_score_norm": 0.6, "char3_jaccard": 0.4}
    one = {r.query_id: r.gold_rank for r in rerank.gold_ranks(rerank.rerank(feats, w), feats, gold).collect()}
    all_ = {r.query_id: r.gold_rank for r in rerank.trial_ranks(feats, feats, gold, {"w": w, "e": {"embedding_score_norm": 1.0}}).filter("trial = 'w'").collect()}
    assert one == all_ and one[6] is None


def test_stream_is_enriched(spark, tmp_path):
    spark.createDataFrame([(1, " Acetic  Acid "), (2, "unknown"), (1, "acetic acid")], "i int, name string").selectExpr("timestamp_seconds(i) as ts", "name").write.parquet(f"{tmp_path}/in")
    surfaces = spark.createDataFrame([("acetic acid", ["176"])], "normalized_name string, candidate_cids array<string>")
    stream = spark.readStream.schema("ts timestamp, name string").parquet(f"{tmp_path}/in")
    enrich.write_each(enrich.enrich_stream(stream, surfaces), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.normalized_name, tuple(r.candidate_cids or ())) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("acetic acid", ("176",)), ("unknown", ())}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text('cid,name\n1,Acetic Acid\n1,"Ethanoic  acid"\n2,alone\n,nobody\n3,\n3,x\nbad,row,here\n')
    got = tables.read_synonym_csv(spark, str(tmp_path / "s.csv"), ["cid", "name"])
    assert {(r.cid, r.name, r.cid_size) for r in got.collect()} == {("1", "acetic acid", 2), ("1", "ethanoic acid", 2)}
    lab = tables.lab(spark.createDataFrame([(1, " A b ", None)], "query_i long, Compound_Name string, refmet string")).first()
    assert (lab.metabolite_normalized, lab.refmet_name, lab.has_refmet_name) == ("a b", "", False)
    with pytest.raises(ValueError):
        tables.lab(spark.createDataFrame([(1,)], "query_i long"))
    t = tables.targets(spark.createDataFrame([(2, "B"), (1, "b"), (3, "c"), (4, "")], "position long, refmet_name string"))
    assert [(r.target_id, r.refmet_name) for r in t.orderBy("target_id").collect()] == [(0, "b"), (1, "c")]
