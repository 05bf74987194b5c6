"""Queries of candidate pools, identifier lists, fallbacks, review sheets and aligned tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, decide, evaluate, pools, rerank
from . import oracle
from .oracle import _ALL, _FEATS, _LAB, _PRED, _TIERED, n3
from .queries import CORE, POLICY, _features, _gold, _lab, _neighbors, _parts, _pred, _profiles, _t, _targets, _tiered, _vectors

TIERS = {"high_confidence_refmet_auto_accept": "high", "medium_confidence_refmet_review": "medium", "low_confidence_pubmed_fallback": "low"}
#: The pool's weights without the sequence ratio, which SQL can't repeat.
POOL = {k: v for k, v in pools.POOL_WEIGHTS.items() if k != "sequence_ratio"}


def _surfaces(spark, d):
    """(target_id, normalized_name, cids) of the label dictionary."""
    t = _targets(spark, d).select("target_id", F.col("refmet_normalized").alias("normalized_name"))
    parts = _t(spark, d, "part").select(T.normalize(F.col("p_name"), "n3").alias("n"), F.col("p_brand").alias("cid"))
    return t.join(parts, F.col("normalized_name") == F.col("n")).groupBy("target_id", "normalized_name").agg(F.collect_set("cid").alias("cids"))


def _wanted(spark, d):
    brand = _t(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("cid"))
    return _lab(spark, d).select(F.col("query_i").alias("query_id"), F.col("metabolite_normalized").alias("name")).join(brand, "query_id")


def hybrid_pool(spark, d):
    q, t = _profiles(spark, d)
    same = q.select(F.col("q_id").alias("query_id"), "q_compact").join(t.select(F.col("t_id").alias("target_id"), "t_compact"), (F.col("q_compact") == F.col("t_compact")) & (F.col("q_compact") != ""))
    sources = {"trigrams": _neighbors(spark, d), "compact": same.select("query_id", "target_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))}
    pooled = pools.pool(sources)
    feats = rerank.features(pooled.select("query_id", "target_id", "score", "rank"), q, t, "A", False)
    out = pools.pool_scores(pooled, feats, POOL).filter("new_rank <= 5")
    return out.select("query_id", "target_id", "source", "new_rank", F.round("scaled_score", 6).alias("scaled_score"), F.round("hybrid_score", 6).alias("hybrid_score"))


def embedding_only_predictions(spark, d):
    base, gold = _neighbors(spark, d), _gold(spark, d)
    ranked = pools.as_ranked(_features(spark, d))
    out = rerank.predictions(ranked, gold, rerank.gold_ranks(ranked, base, gold))
    return out.select("query_id", "split", "predicted_target_id", F.round("prediction_score", 6).alias("prediction_score"), "top1_relation_to_query", "top1_exact_correct", "gold_rank")


def available_relevant(spark, d):
    return pools.available_relevant(_wanted(spark, d), _surfaces(spark, d)).drop("name")


def nonexact_metrics(spark, d):
    s = _surfaces(spark, d)
    return pools.nonexact_metrics(_neighbors(spark, d), pools.available_relevant(_wanted(spark, d), s), s)


def mapping_audit(spark, d):
    best = corpus.best_mappings(_targets(spark, d), corpus.unique_surfaces(_parts(spark, d))).select("target_id", "method", "n_cids")
    rows = _gold(spark, d).join(best, "target_id", "left").withColumn("mapped", F.col("method").isNotNull())
    return pools.audit(rows, ("mapped", "method"), "n_cids")


def coverage_pivot(spark, d):
    return pools.mean_pivot(_tiered(spark, d), "split", "confidence_tier", TIERS, "top1_exact_correct")


def _cases(spark, d):
    cids = _surfaces(spark, d).select(F.col("target_id").alias("gold_id"), F.col("cids").alias("gold_cids"))
    gold = _gold(spark, d).select("query_id", F.col("target_id").alias("gold_id")).join(cids, "gold_id", "left")
    rows = _tiered(spark, d).join(gold, "query_id").withColumn("has_cid", F.col("gold_cids").isNotNull())
    return pools.fallback_cases(rows, "high_confidence_refmet_auto_accept", 0).select("query_id", "gold_cids")


def fallback_comparison(spark, d):
    """The highest tier and all ranks: these tables leave no case in the lowest one, nor beyond ten."""
    trials = {"embedding_only": {"embedding_score_norm": 1.0}, "refmet_weights": CORE}
    ranks = pools.same_cid_ranks(_features(spark, d), _cases(spark, d), _surfaces(spark, d).select("target_id", "cids"), trials)
    return evaluate.rank_metrics(ranks, by=("trial",), ks=(1, 5, 10))


def fallback_tuner(spark, d):
    """Weights are tuned on the validation split."""
    cids = _surfaces(spark, d).select("target_id", F.col("cids").alias("gold_cids"))
    wanted = _gold(spark, d).filter("split = 'validation'").join(cids, "target_id").select("query_id", "gold_cids")
    ranks = pools.same_cid_ranks(_features(spark, d, True), wanted, _surfaces(spark, d).select("target_id", "cids"), pools.fallback_trials(rerank.CLOSED_SET))
    return rerank.best_trial(ranks)


def review_sheet(spark, d):
    """The part's type stands for a label whose surface differs: names and their own labels hardly do in these tables."""
    kind = _t(spark, d, "part").select(F.col("p_partkey").alias("query_id"), T.normalize(F.col("p_type"), "n3").alias("gold"))
    pairs = _lab(spark, d).select(F.col("query_i").alias("query_id"), F.col("metabolite_normalized").alias("query")).join(kind, "query_id")
    return pools.review_sheet(rerank.rerank(_features(spark, d), CORE), pairs)


def upsert_rows(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"), F.lit("old").alias("state"))
    newer = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.round(F.col("balance") + 1, 2).alias("balance"), F.lit("new").alias("state"))
    return pools.upsert(rows, newer, ["c_custkey"])


def keep_last_rows(spark, d):
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    return pools.keep_last(rows, ["o_custkey"], ["day", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


def aligned_methods(spark, d):
    base, gold, feats = _neighbors(spark, d), _gold(spark, d), _features(spark, d)
    ranks = lambda ranked, name: rerank.gold_ranks(ranked, base, gold).withColumnRenamed("gold_rank", name)
    return pools.aligned({"first": gold.select("query_id", "split"), "core": ranks(rerank.rerank(feats, CORE), "core_rank"), "own": ranks(pools.as_ranked(feats), "own_rank")}, ["query_id"])


def _vector_pairs(spark, d):
    v = _vectors(spark, d).select("id", "v")
    a = v.filter("id % 2 = 0").select(F.floor(F.col("id") / 2).alias("pair_id"), F.col("v").alias("a"))
    return a.join(v.filter("id % 2 = 1").select(F.floor(F.col("id") / 2).alias("pair_id"), F.col("v").alias("p")), "pair_id")


def batch_ranks(spark, d):
    ranks = pools.batch_ranks(_vector_pairs(spark, d), F.floor(F.col("pair_id") / 32))
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("hit_1"))


def alignment_check(spark, d):
    pairs = _vector_pairs(spark, d)
    n = _vectors(spark, d).agg(F.floor((F.max("id") + 1) / 2).alias("n"))
    random = pairs.select(F.col("pair_id").alias("other"), F.col("p").alias("r"))
    rows = pairs.join(F.broadcast(n)).withColumn("at", (F.col("pair_id") * 7 + 3) % F.col("n"))  # one row
    return pools.alignment(rows.join(random, F.col("at") == F.col("other")))


def joined_identifiers(spark, d):
    lists = F.array(F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string"), F.substring("p_type", 1, 3))
    rows = _t(spark, d, "part").select("p_brand", "p_partkey", lists.alias("lists"))
    joined = pools.joined_lists(rows, "p_brand", "lists", "p_partkey")
    return joined.select("p_brand", "joined", pools.numeric_join(F.split("joined", r"\|")).alias("by_number"))


def complete_rows(spark, d):
    turns = _t(spark, d, "conversations")
    return pools.complete(turns, ["role", "text"], "text", "the ").groupBy("role").agg(F.count("*").alias("n"))


def first_names(spark, d):
    few = pools.first_rows(_t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 100)
    return few.select("p_partkey", T.normalize(F.col("p_name"), "n3").alias("name")).filter("name <> '' and p_partkey % 2 = 0")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_pool, embedding_only_predictions, available_relevant, nonexact_metrics, mapping_audit, coverage_pivot, fallback_comparison, fallback_tuner,
        review_sheet, upsert_rows, keep_last_rows, aligned_methods, batch_ranks, alignment_check, joined_identifiers, complete_rows, first_names,
    )
}

_CIDS = f"tc as (select target_id, t, list(distinct p_brand) as cids from targets join part on {n3('p_name')} = t group by target_id, t)"
_AVAILABLE = """
corp as (select cid, count(*) as c from (select unnest(cids) as cid from tc) group by cid),
meta as (select query_i as query_id, p_brand as cid, q from lab join part on query_i = p_partkey),
ex as (select query_id, count(*) as c from meta join tc on t = q where list_contains(cids, cid) group by query_id),
av as (
  select query_id, cid, q, coalesce(corp.c, 0) as n_surfaces, coalesce(ex.c, 0) as n_exact, greatest(coalesce(corp.c, 0) - coalesce(ex.c, 0), 0) as n_available
  from meta left join corp using (cid) left join ex using (query_id))"""
_POOL_SCORE = " + ".join(f"{w!r}::double * {k}" for k, w in POOL.items())
_TWO = "ranked0 as (select *, score as s, rank as new_rank from feats)"
_HITS = ", ".join(
    f"round(avg((coalesce(h{k}, 0) > 0)::int), 6) as hit_{k}, round(avg(coalesce(h{k}, 0) / {k}), 6) as precision_{k}, round(avg(coalesce(h{k}, 0) / n_available), 6) as recall_{k}"
    for k in (1, 5, 10)
)
_PAIRS = """
v as (select vec_id as id, embedding::double[] as v from embeddings),
pairs as (select a.id // 2 as pair_id, a.v as a, p.v as p from v a join v p on a.id % 2 = 0 and p.id = a.id + 1)"""
_CASES = """
cases as (
  select tiered.query_id, tc.cids as gold_cids from tiered join gold g on g.query_id = tiered.query_id join tc on tc.target_id = g.target_id
  where confidence_tier = 'high_confidence_refmet_auto_accept' and coalesce(gold_rank > 0, true))"""


def _trial_ranks(name: str, score: str) -> str:
    return f"""
select '{name}' as trial, c.query_id, min(r) filter (len(list_intersect(gold_cids, cids)) > 0) as gold_rank
from cases c left join (select *, row_number() over (partition by query_id order by {score} desc, rank, target_id) as r from ranked) k on k.query_id = c.query_id
left join tc on tc.target_id = k.target_id group by c.query_id"""


ORACLE_SQL: dict[str, str] = {
    "hybrid_pool": f"""
with {_LAB}, {_FEATS},
pool as (
  select query_id, target_id, score, rank, 'trigrams' as source, 0 as priority from nn
  union all select query_id, target_id, 1.0, 1, 'compact', 1 from q3 join t3 on qc = tc and qc <> ''),
sc as (select *, (score - min(score) over w) / coalesce(nullif(max(score) over w - min(score) over w, 0), 1) as scaled_score from pool window w as (partition by query_id, source)),
one as (select * from (select *, row_number() over (partition by query_id, target_id order by priority, rank) as k from sc) where k = 1),
full_ as (
  select one.query_id, one.target_id, one.source, one.rank, one.score, scaled_score, (q = t and q <> '')::int::double as normalized_exact, {oracle.jaccard('q3', 't3')} as char3_jaccard,
    {oracle.jaccard('qt', 'tt')} as token_jaccard, (ql <> '' and ql = tl)::int::double as lipid_signature_match, (qcl <> '' and qcl = tcl)::int::double as lipid_class_match, (qs <> ts)::int::double as stereo_mismatch
  from one join q3 using (query_id) join t3 using (target_id)),
h as (select *, round({_POOL_SCORE}, 9) as s from full_)
select query_id, target_id, source, new_rank, round(scaled_score, 6) as scaled_score, round(s, 6) as hybrid_score
from (select *, row_number() over (partition by query_id order by s desc, rank, target_id)::int as new_rank from h) where new_rank <= 5""",
    "embedding_only_predictions": f"""
with {_LAB}, {_FEATS}, {_TWO}, {_PRED.replace('ranked ', 'ranked0 ')}
select query_id, split, predicted_target_id, round(prediction_score, 6) as prediction_score, top1_relation_to_query, top1_exact_correct, gold_rank from pred""",
    "available_relevant": f"with {_LAB}, {_CIDS}, {_AVAILABLE} select query_id, cid, n_surfaces, n_exact, n_available from av",
    "nonexact_metrics": f"""
with {_LAB}, {_FEATS}, {_CIDS}, {_AVAILABLE},
hits as (
  select nn.query_id, row_number() over (partition by nn.query_id order by rank) as r, list_contains(cids, cid) as hit
  from nn join av using (query_id) join tc using (target_id) where n_available > 0 and tc.t <> av.q),
f as (select query_id, min(r) filter (hit) as first, count(*) filter (hit and r <= 1) as h1, count(*) filter (hit and r <= 5) as h5, count(*) filter (hit and r <= 10) as h10 from hits group by query_id)
select count(*) as n, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, {_HITS} from av left join f using (query_id) where n_available > 0""",
    "mapping_audit": f"""
with {_LAB}, {_CIDS}
select tc.target_id is not null as mapped, case when tc.target_id is not null then 'exact' end as method, count(*) as n, round(avg(len(cids)), 6) as mean
from gold left join tc on tc.target_id = gold.target_id group by 1, 2""",
    "coverage_pivot": f"{_ALL}, {_TIERED} select split, " + ", ".join(f"round(avg(top1_exact_correct::int) filter (confidence_tier = '{k}'), 6) as {v}" for k, v in TIERS.items()) + " from tiered group by split",
    "fallback_comparison": f"""
{_ALL}, {_TIERED}, {_CIDS}, {_CASES}, r as ({_trial_ranks('embedding_only', 'embedding_score_norm')} union all {_trial_ranks('refmet_weights', 's')})
select trial, {oracle._rank_means('gold_rank', (1, 5, 10))} from r group by trial""",
    "review_sheet": f"""
with {_LAB}, {_FEATS},
kinds as (select query_i as query_id, q, {n3('p_type')} as k from lab join part on p_partkey = query_i),
b as (select query_id from kinds where {oracle.relation('q', 'k')} = 'different'),
h as (
  select query_id, t, row_number() over (partition by query_id order by new_rank) as r
  from ranked semi join b using (query_id) where {oracle.relation('q', 't')} = 'different')
select query_id, """ + ", ".join(f"max(t) filter (r = {k}) as top{k}" for k in range(1, 11)) + " from h where r <= 10 group by query_id",
    "upsert_rows": """
select c_custkey, case when c_custkey % 3 = 0 then round(c_acctbal::double + 1, 2) else c_acctbal::double end as balance, case when c_custkey % 3 = 0 then 'new' else 'old' end as state from customer""",
    "keep_last_rows": "select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderdate::date desc, o_orderkey desc) = 1",
    "aligned_methods": f"""
{_ALL}
select g.query_id, g.split, ranks.base_rank, coalesce(own_rank, ranks.base_rank) as core_rank, ranks.base_rank as own_rank from gold g join ranks using (query_id)""",
    "batch_ranks": f"""
with {_PAIRS},
s as (
  select a.pair_id, 1 + count(*) filter (round(list_inner_product(a.a, b.p), 9) > round(list_inner_product(a.a, a.p), 9)) as rank
  from pairs a join pairs b on a.pair_id // 32 = b.pair_id // 32 group by a.pair_id)
select count(*) as n, round(avg(1.0 / rank), 6) as mrr, round(avg((rank = 1)::int), 6) as hit_1 from s""",
    "alignment_check": f"""
with {_PAIRS},
s as (
  select round(list_inner_product(a.a, a.p), 9) as pos, round(list_inner_product(a.a, b.p), 9) as neg
  from pairs a join pairs b on b.pair_id = (a.pair_id * 7 + 3) % (select (max(id) + 1) // 2 from v))
select count(*) as n, round(avg(pos), 6) as mean_positive, round(avg(neg), 6) as mean_random, round(avg((pos > neg)::int), 6) as positive_higher from s""",
    "joined_identifiers": """
with e as (
  select p_brand, p_partkey as o, unnest([p_size::varchar, (p_size % 7)::varchar, substr(p_type, 1, 3)]) as x, unnest([0, 1, 2]) as i from part),
f as (select p_brand, x, min(o * 10 + i) as first from e group by all)
select p_brand, string_agg(x, '|' order by first) as joined, string_agg(x, '|' order by try_cast(x as bigint) nulls last, x) as by_number from f group by p_brand""",
    "complete_rows": "select role, count(*) as n from conversations where role is not null and text is not null and not contains(lower(text), 'the ') group by role",
    "first_names": f"select p_partkey, {n3('p_name')} as name from (select * from part order by p_partkey limit 100) where {n3('p_name')} <> '' and p_partkey % 2 = 0",
}
