"""One query for each operator, on its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reach_workers
from . import ball_tree, compression_language, grace_dedup, mixture, packing, partenum, secret_forest, token_counts, token_files, url_templates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return token_counts.suffix_sums(histogram)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents"))


#: Fixed rules of the query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_templates.judge(pages, url_templates.labels_of_pages(pages, _table(spark, sf_dir, "labels")), URL_RULES)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_language.identify(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ball_tree": op3_ball_tree,
    "op4_mixture": op4_mixture,
    "op5_url_templates": op5_url_templates,
    "op6_token_files": op6_token_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as s from documents)
select doc_id, min(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = min(doc_id) over (partition by s) as kept, sha256(s) as text_sha256
from t""",
    "op3_ball_tree": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op4_mixture": r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5('17:' || cast(doc_id as varchar)), 1, 12) as bigint) as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w
  from d group by source),
f as (
  select *, sum(source_size) over () as total,
         sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(w) over (o rows between current row and unbounded following) as w_rest
  from s window o as (order by cap / w, source nulls last)),
c as (select *, rest::hugeint * w > cap::hugeint * w_rest as capped from f),
t as (
  select source, source_size,
         case when capped then cap::double
              else (w * (total - sum(case when capped then cap else 0 end) over ()))::double
                   / (sum(case when capped then 0 else w end) over ())::double end as target
  from c),
g as (select *, least(floor(target / source_size), 3)::bigint as whole from t),
k as (
  select d.source, d.h, g.target - g.whole * g.source_size as missing,
         sum(sum(d.size)) over (partition by d.source order by d.h) as cum
  from d join g on d.source is not distinct from g.source group by d.source, d.h, g.target, g.whole, g.source_size),
b as (
  select source, -1::bigint as h, any_value(missing) as off from k group by source
  union all select source, h, abs(cum - missing) from k where missing > 0),
u as (select source, min_by(h, (off, h)) as upto from b group by source)
select d.doc_id, d.size, g.source_size, g.target, d.size * (g.whole + (d.h <= u.upto)::bigint) as taken
from d join g on d.source is not distinct from g.source join u on d.source is not distinct from u.source""",
    "op8_jaccard_join": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g
  from d),
e as (select doc_id, len(g) as n, unnest(g) as x from s),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select u, v from p where 100 * c >= 75 * (na + nb - c) union all select v, u from p where 100 * c >= 75 * (na + nb - c)),
r(doc_id, m) as (select doc_id, doc_id from documents union select l.v, r.m from r join l on l.u = r.doc_id)
select s.doc_id, len(g)::bigint as n_shingles, min(m) as component_id from s join r using (doc_id) group by s.doc_id, g""",
}
