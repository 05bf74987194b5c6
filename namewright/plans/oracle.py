"""DuckDB SQL for the registered queries, over the same tables. Made from shared steps."""

from __future__ import annotations

from ..functions import text as T
from ..operators import rerank

_N3 = r"regexp_replace(lower(trim({})), '\s+', ' ', 'g')"
_COMPACT = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def n3(x: str) -> str:
    return _N3.format(x)


def compact(x: str) -> str:
    return _COMPACT.format(x)


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({x}, '[^a-z0-9]+'), lambda t: t <> ''))"


def char3(x: str) -> str:
    k = compact(x)
    return f"case when {k} = '' then []::varchar[] else list_distinct(list_transform(range(1, greatest(length({k}) - 2, 1) + 1), lambda i: substr({k}, i, 3))) end"


def jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


def relation(q: str, t: str) -> str:
    return f"""case when {q} <> '' and {q} = {t} then 'exact_normalized'
      when {compact(q)} <> '' and {compact(q)} = {compact(t)} then 'exact_compact'
      when {q} <> '' and {t} <> '' and (contains({t}, {q}) or contains({q}, {t})) then 'substring'
      when len({tokens(q)}) > 0 and list_sort({tokens(q)}) = list_sort({tokens(t)}) then 'same_tokens' else 'different' end"""


_POINTS = """(case when regexp_matches({0}, '^[0-9]+$') then -10 else 0 end + case when length({0}) between 4 and 80 then 3 else 0 end
  + case when regexp_matches({0}, '[a-z]') then 2 else 0 end + case when regexp_matches({0}, '[0-9].*[a-z]|[a-z].*[0-9]') then 1 else 0 end
  + case when regexp_matches({0}, 'acid|ate|ine|ol|ose|ide|lipid|phosphate|carnitine|coenzyme|vitamin') then 2 else 0 end
  - case when regexp_matches({0}, 'deprecated|unknown|mixture|unspecified|not available') then 4 else 0 end)"""
_TRAIN = r"""(length({0}) between 3 and 180 and length({1}) >= 3 and regexp_matches({1}, '[a-z]')
  and not regexp_matches({0}, '\[[a-z]{{1,8}}\]\s*$') and not regexp_matches({0}, '^[a-z]{{1,3}}$'))"""


def points(x: str) -> str:
    return _POINTS.format(x)


def trainable(x: str) -> str:
    return _TRAIN.format(x, compact(x))


_CID = "concat_ws('_', label, vec_id % 3)"
_KNN = f"""
with v as (select vec_id as id, embedding::double[] as v, {_CID} as cid from embeddings),
p as (select q.id as query_id, c.id as target_id, round(list_inner_product(q.v, c.v), 9) as score from v q join v c on q.id % 4 = 0 and q.id <> c.id),
nn as (select *, row_number() over (partition by query_id order by score desc, target_id)::int as rank from p),
s as (select cid, count(*) as cid_size from v group by cid),
rel as (
  select nn.query_id, nn.rank as r, a.cid = b.cid as hit from nn join v a on a.id = nn.query_id join v b on b.id = nn.target_id where nn.rank <= 10),
f as (
  select query_id, min(r) filter (hit) as first, count(*) filter (hit and r <= 1) as h1, count(*) filter (hit and r <= 5) as h5, count(*) filter (hit and r <= 10) as h10
  from rel group by query_id),
m as (
  select v.id as query_id, s.cid_size, coalesce(1.0 / f.first, 0.0) as rr, coalesce(h1, 0) as h1, coalesce(h5, 0) as h5, coalesce(h10, 0) as h10
  from v join s using (cid) left join f on f.query_id = v.id where v.id % 4 = 0)"""
_MEANS = "count(*) as n, round(avg(rr), 6) as mrr, " + ", ".join(
    f"round(avg((h{k} > 0)::int), 6) as hit_{k}, round(avg(h{k} / {k}), 6) as precision_{k}, round(avg(h{k} / greatest(cid_size - 1, 1)), 6) as recall_{k}" for k in (1, 5, 10)
)
_BUCKET = "case when {0} = 2 then '2' when {0} between 3 and 5 then '3-5' when {0} between 6 and 10 then '6-10' when {0} between 11 and 20 then '11-20' else '21+' end"
_BUCKETS = _BUCKET.format("cid_size")
_ORDER = "list_position(['2','3-5','6-10','11-20','21+'], bucket)::int"

_SYN = f"""
with n as (select p_partkey as row_id, p_brand as cid, {n3('p_name')} as name from part),
s as (select cid, count(*)::int as cid_size from n where name <> '' and cid is not null group by cid),
syn as (select n.*, s.cid_size from n join s using (cid) where name <> '' and cid_size >= 2)"""

_CONDENSED = f"""
n as (select p_brand as cid, trim(p_name) as display_name, {n3('p_name')} as normalized_name from part),
u as (select cid, normalized_name, min(display_name) as display_name from n where normalized_name <> '' group by all),
k as (select *, {compact('normalized_name')} as compact_name, length(normalized_name)::int as name_len, {points('normalized_name')}::int as quality_score from u),
r as (select *, row_number() over (partition by cid order by quality_score desc, name_len, normalized_name)::int as cid_name_rank from k where length(compact_name) > 1),
condensed as (select cid, display_name, normalized_name, compact_name, name_len, quality_score, cid_name_rank from r where cid_name_rank <= 20)"""

_SURF = f"""
u as (
  select {n3('p_name')} as normalized_name, min(trim(p_name)) as display_name, list_sort(list(distinct p_brand)) as cids
  from part where p_brand is not null group by 1 having {n3('p_name')} <> ''),
surfaces as (select *, len(cids)::int as n_candidate_cids from u)"""

_LAB = f"""
raw as (
  select p_partkey as query_i, p_name as refmet_name, case p_partkey % 5
    when 0 then p_name when 1 then upper(p_name) when 2 then replace(p_name, ' ', '-') when 3 then concat_ws(' ', p_name, p_type)
    else regexp_replace(p_name, '^([^ ]*) (.*)$', '\\2 \\1') end as metabolite_name
  from part),
lab as (select *, {n3('metabolite_name')} as q, {n3('refmet_name')} as g from raw),
targets as (
  select row_number() over (order by refmet_name) - 1 as target_id, refmet_name, t from (
    select {n3('p_name')} as t, min(p_name) as refmet_name from part group by 1) where t <> ''),
gold as (
  select query_i as query_id, target_id, case when target_id is null then 'unlabeled_or_unmapped' when h < 0.6 then 'train' when h < 0.6 + 0.2 then 'validation' else 'test' end as split
  from (select lab.*, target_id, ('0x' || substr(md5('42:' || query_i), 1, 8))::bigint / 4294967296.0 as h from lab left join targets on lab.g = targets.t))"""

_W = {k: v for k, v in rerank.CLOSED_SET.items() if k != "sequence_ratio"}
_STEREO, _CLASS = T.STEREO_ANY, r"^([a-z]{1,8})\b"
_LIPID = T.LIPID_CHAINS


def _lipid(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{_LIPID}'), lambda m: regexp_extract(m, '{_LIPID}', 2) || ':' || regexp_extract(m, '{_LIPID}', 3)), '|')"


def _score(w: dict[str, float]) -> str:
    return "round(" + (" + ".join(f"{v!r} * {k}" for k, v in w.items() if v) or "0.0") + ", 9)"


_FEATS = f"""
q3 as (select query_i as query_id, q, {compact('q')} as qc, {char3('q')} as q3, {tokens('q')} as qt, {_lipid('q')} as ql, regexp_extract(q, '{_CLASS}', 1) as qcl, regexp_matches(q, '{_STEREO}') as qs from lab),
t3 as (select target_id, t, {compact('t')} as tc, {char3('t')} as t3, {tokens('t')} as tt, {_lipid('t')} as tl, regexp_extract(t, '{_CLASS}', 1) as tcl, regexp_matches(t, '{_STEREO}') as ts from targets),
cand as (select query_id, target_id, round({jaccard('q3', 't3')}, 9) as score from q3, t3 where len(list_intersect(q3, t3)) > 0),
nn as (select * from (select *, row_number() over (partition by query_id order by score desc, target_id)::int as rank from cand) where rank <= 16),
feats as (
  select nn.*, q, t, (score + 1) / 2 as embedding_score_norm, 1.0 / rank as rank_prior, (q = t and q <> '')::int::double as normalized_exact,
    (qc = tc and qc <> '')::int::double as compact_exact, {jaccard('q3', 't3')} as char3_jaccard, {jaccard('qt', 'tt')} as token_jaccard,
    (ql <> '' and ql = tl)::int::double as lipid_signature_match, (qcl <> '' and qcl = tcl)::int::double as lipid_class_match, (qs <> ts)::int::double as stereo_mismatch
  from nn join q3 using (query_id) join t3 using (target_id)),
ranked as (select *, row_number() over (partition by query_id order by s desc, rank, target_id)::int as new_rank from (select *, {_score(_W)} as s from feats))"""

_PRED = """
ranks as (
  select g.query_id, (select min(rank) from nn where nn.query_id = g.query_id and nn.target_id = g.target_id) as base_rank,
    (select min(new_rank) from ranked r where r.query_id = g.query_id and r.target_id = g.target_id) as own_rank from gold g),
pred as (
  select g.query_id, g.split, a.target_id as predicted_target_id, a.s as prediction_score, b.s as second_score, round(a.s - b.s, 9) as score_margin,
    coalesce(""" + relation("a.q", "a.t") + """, 'different') as top1_relation_to_query, coalesce(a.target_id = g.target_id, false) as top1_exact_correct, coalesce(own_rank, base_rank) as gold_rank
  from gold g left join ranked a on a.query_id = g.query_id and a.new_rank = 1 left join ranked b on b.query_id = g.query_id and b.new_rank = 2 join ranks on ranks.query_id = g.query_id)"""
_ALL = f"with {_LAB}, {_FEATS}, {_PRED}"


def _rank_means(rank: str, ks: tuple[int, ...]) -> str:
    hits = ", ".join(f"round(avg(case when {rank} <= {k} then 1.0 else 0.0 end), 6) as hit_{k}" for k in ks)
    return f"count(*) as n, round(avg(coalesce(1.0 / {rank}, 0.0)), 6) as mrr, {hits}, quantile_cont({rank}, 0.5)::double as median_rank"


_SUPPORTED = "top1_relation_to_query in ('exact_normalized', 'exact_compact', 'same_tokens', 'substring')"
_OK_SCORE = "coalesce(prediction_score, '-inf'::double) >= 0.3"
_MARGIN = "coalesce(score_margin, '-inf'::double)"


def _grid(rows: str, column: str, points: int) -> str:
    at = "[" + ", ".join(f"{i}/{points - 1}.0::double" for i in range(points)) + "]"
    return f"grid as (select distinct round(unnest(quantile_cont({column}, {at})), 9) as threshold from {rows})"


_TIERED = f"""
tiered as (
  select *, case when {_OK_SCORE} and ({_MARGIN} >= 0.02 or ({_MARGIN} >= 0.0283 and {_SUPPORTED})) then 'high_confidence_refmet_auto_accept'
    when {_MARGIN} < 0.005 or not {_OK_SCORE} then 'low_confidence_pubmed_fallback' else 'medium_confidence_refmet_review' end as confidence_tier from pred)"""
_CASE = "case when top1_exact_correct then 'top1_correct' when gold_rank <= 10 then 'gold_in_top10_not_rank1' when gold_rank <= 256 then 'gold_in_top256_not_top10' else 'gold_not_retrieved_top256' end"


def _within(group: str, rows: str) -> str:
    return f"select split, {group}, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as fraction from {rows} group by split, {group}"


def _ablation() -> str:
    parts = []
    for name, w in rerank.ablations(_W).items():
        parts.append(f"select '{name}' as trial, query_id, target_id, row_number() over (partition by query_id order by {_score(w)} desc, rank, target_id) as r from feats")
    return " union all ".join(parts)


_GRAMS = """
select id, w[i:i + {n} - 1] as gram from (select id, w, unnest(range(1, greatest(length(w) - {n} + 1, 1) + 1)) as i from {words}) where {n} = 3 or length(w) >= {n}"""


def _grams(rows: str, name: str) -> str:
    words = f"(select id, ' ' || unnest(list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '')) || ' ' as w from {rows})"
    return f"{name} as (select id, gram, count(*) as tf from (" + " union all ".join(_GRAMS.format(n=n, words=words) for n in (3, 4, 5)) + ") group by all)"


_TFIDF = f"""
with {_LAB},
c as (select target_id as id, t as name from targets),
qq as (select query_i as id, q as name from lab),
{_grams('c', 'cg')}, {_grams('qq', 'qg')},
idf as (select gram, ln((1.0 + (select count(*) from c)) / (1.0 + count(*))) + 1.0 as idf from cg group by gram),
cw as (select id, gram, (1 + ln(tf)) * idf as w from cg join idf using (gram)),
qw as (select id, gram, (1 + ln(tf)) * idf as w from qg join idf using (gram)),
cn as (select id, sqrt(sum(w * w)) as norm from cw group by id),
qn as (select id, sqrt(sum(w * w)) as norm from qw group by id),
hit as (
  select qw.id as query_id, cw.id as target_id, round(sum(qw.w / qn.norm * (cw.w / cn.norm)), 9) as score
  from qw join cw using (gram) join qn on qn.id = qw.id join cn on cn.id = cw.id group by all),
r as (select *, row_number() over (partition by query_id order by score desc, target_id)::int as rank from hit)"""

_X = "lower(concat('PC(', p_size, ':', p_size % 7, ') cis-', p_name))"
_V = f"({n3('p_name')} || '*_' || p_size)"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\[[^\]]*m[^\]]*\]', ' ', 'g'), '[@_]\s*[-+]?\d+(?:\.\d+)?\s*$', ' ', 'g'), '\s+[+-]\s*\d+(?:\.\d+)?\s*$', ' ', 'g'), '\*', ' ', 'g'), '\s+', ' ', 'g'))"
_SPACED = r"trim(regexp_replace(regexp_replace({0}, '[()\[\]{{}};,/_]+', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "retrieval_metrics": f"{_KNN} select {_MEANS} from m",
    "retrieval_metrics_by_bucket": f"{_KNN}, b as (select *, {_BUCKETS} as bucket from m) select bucket, {_ORDER} as bucket_order, {_MEANS} from b group by bucket",
    "retrieval_ranks": f"{_KNN} select query_id, round(rr, 6) as rr, (h10 > 0)::int::double as hit_10 from m",
    "exact_knn_topk": f"{_KNN} select query_id, target_id, round(score, 6) as score, rank from nn where rank <= 10",
    "hard_negatives_knn": f"""{_KNN}, h as (
  select nn.query_id, nn.target_id, round(score, 6) as score from nn join v a on a.id = nn.query_id join v b on b.id = nn.target_id where nn.rank <= 50 and a.cid <> b.cid),
k as (select *, row_number() over (partition by query_id order by score desc, target_id)::int as rank from h) select * from k where rank <= 3""",
    "synonym_table": f"{_SYN} select row_id, cid, name, cid_size from syn",
    "synonym_summary": f"{_SYN} select count(*) as n_rows, count(distinct cid) as n_cids, min(cid_size)::bigint as min_size, max(cid_size)::bigint as max_size, avg(cid_size) as mean_size, quantile_cont(cid_size, 0.5)::double as median_size from syn",
    "normalize_documents": r"select doc_id, md5(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) as digest from documents",
    "name_keys": f"""with n as (select p_partkey, {n3("concat_ws(' ', p_name, p_type)")} as norm from part)
select p_partkey, norm, {compact('norm')} as compact, array_to_string(list_sort({tokens('norm')}), '|') as tokens, len({char3('norm')})::int as n_char3,
  substr({compact('norm')}, 1, 8) || '_' || least(cast(length({compact('norm')}) / 8 as integer), 32) as hard_key, least(length({compact('norm')}) // 8, 24)::int as length_bin, {trainable('norm')} as trainable, {points('norm')}::int as quality from n""",
    "name_similarity": f"""with n as (select p_partkey, {n3('p_name')} as a, {n3("concat_ws(' ', p_name, p_type)")} as b from part)
select p_partkey, round({jaccard(tokens('a'), tokens('b'))}, 6) as token_jaccard, round({jaccard(char3('a'), char3('b'))}, 6) as char3_jaccard,
  round(1.0 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) as edit, {relation('a', 'b')} as relation from n""",
    "chemistry_signatures": f"""with n as (select p_partkey, p_type, {_X} as x from part)
select p_partkey, {_lipid('x')} as lipid_a, concat_ws('|', regexp_extract(x, '{T.LIPID_FIRST}', 1), regexp_extract(x, '{T.LIPID_FIRST}', 2), regexp_extract(x, '{T.LIPID_FIRST}', 3)) as lipid_b,
  regexp_extract(x, '{_CLASS}', 1) as cls, regexp_matches(x, '{_STEREO}') as stereo_flag, array_to_string(list_sort(regexp_extract_all(x, '{T.STEREO_MARKS}')), '|') as stereo,
  regexp_matches(x, '{T.LIPID_CLASSES}') as has_lipid, regexp_matches(p_type, '{T.SALT_FORMS}') as salt from n""",
    "name_variants": f"""with n as (select p_partkey, {_V} as b from part),
c as (select p_partkey, b, {_CLEAN.format('b')} as s from n),
v as (
  select p_partkey, 0 as p, 'exact' as method, b as value from c union all select p_partkey, 1, 'strip_instrument_suffix', s from c
  union all select p_partkey, 2, 'punctuation_spaced', {_SPACED.format('s')} from c union all select p_partkey, 3, 'remove_quotes', regexp_replace(b, '[''"`]', '', 'g') from c
  union all select p_partkey, 4, 'remove_terminal_count', trim(regexp_replace(b, '(?:\\s|_)+\\d+$', '', 'g')) from c)
select p_partkey, arg_min(method, p) as method, value from v where value <> '' group by p_partkey, value""".replace("\\\\", "\\"),
    "parse_identifiers": f"""select p_partkey, array_to_string(list_sort(list_distinct([p_size::varchar, p_partkey::varchar])), '|') as cids, {_BUCKET.format('p_size')} as bucket from part""",
    "condense": f"with {_CONDENSED} select * from condensed",
    "condense_summary": f"with {_CONDENSED} select count(*) as n_rows, count(distinct cid) as n_cids, count(distinct normalized_name) as n_names, max(cid_name_rank)::bigint as most_names from condensed",
    "unique_surfaces": f"with {_SURF} select normalized_name, display_name, array_to_string(cids, '|') as candidate_cids, n_candidate_cids from surfaces",
    "surface_summary": f"with {_SURF} select count(*) as n_surfaces, count(*) filter (n_candidate_cids > 1) as n_ambiguous, max(n_candidate_cids)::bigint as most_cids from surfaces",
    "global_surfaces": f"with {_CONDENSED} select normalized_name, min(display_name) as display_name, string_agg(distinct cid, '|' order by cid) as candidate_cids, min(name_len) as name_len, max(quality_score) as quality_score, {compact('normalized_name')} as compact_name from condensed group by normalized_name",
    "targeted_lookup": f"with {_LAB} select {n3('p_name')} as normalized_name, string_agg(distinct p_brand, '|' order by p_brand) as cids from part where {n3('p_name')} in (select q from lab) group by 1",
    "target_dictionary": f"with {_LAB} select target_id, refmet_name, t as refmet_normalized, {compact('t')} as refmet_compact from targets",
    "attached_cids": f"with {_LAB} select target_id, string_agg(distinct p_brand, '|' order by p_brand) as cids from targets join part on {n3('p_name')} = t group by target_id",
    "compact_key_matches": f"""with {_LAB}, s as (select distinct q from lab), m as (select target_id, q as normalized_name, count(*) over (partition by target_id) as n from targets join s on {compact('q')} = {compact('t')})
select target_id, normalized_name from m where n <= 25""",
    "best_mappings": f"""with {_LAB} select target_id, 'exact' as method, string_agg(distinct p_brand, '|' order by p_brand) as cids, count(distinct p_brand) as n_cids
from targets join part on {n3('p_name')} = t group by target_id""",
    "mapping_status": f"""with {_LAB}, l as (select query_i, q as n from lab union all select query_i, g from lab),
h as (select query_i, count(distinct p_brand) as c from l join part on {n3('p_name')} = l.n group by query_i),
s as (select coalesce(c, 0) as c from lab left join h using (query_i))
select case c when 0 then 'unmatched' when 1 then 'exact_unique_cid' else 'exact_ambiguous_cid' end as mapping_status, count(*) as n, sum(c)::bigint as cids from s group by 1""",
    "cid_groups": f"""with n as (select distinct p_brand as cid, {n3('p_name')} as name from part), k as (select * from n where {trainable('name')}),
r as (select *, row_number() over (partition by cid order by md5(name || '42'), name) as rn from k), f as (select * from r where rn <= 24),
g as (select cid, string_agg(name, '|' order by rn) as names, count(*) as n_names, min(name) as first from f group by cid)
select cid, names, n_names, substr({compact('first')}, 1, 8) || '_' || least(cast(length({compact('first')}) / 8 as integer), 32) as hard_key from g where n_names >= 2""",
    "hash_split": "select case when ('0x' || substr(md5(p_brand), 1, 8))::bigint % 1000000 < 200000 then 'validation' else 'train' end as split, count(*) as n, count(distinct p_brand) as cids from part group by 1",
    "hard_key_negatives": f"""with k as (
  select p_partkey as row_id, p_brand as cid, substr({compact('p_name')}, 1, 4) as prefix, least(length({compact('p_name')}) // 8, 24) as bin, md5(p_partkey::varchar) as o from part),
p as (select a.row_id, b.row_id as negative_id, row_number() over (partition by a.row_id order by b.o, b.row_id)::int as rank from k a join k b on a.prefix = b.prefix and a.bin = b.bin and a.cid <> b.cid)
select * from p where rank <= 2""",
    "surface_split": "select row_id from (select p_partkey as row_id, row_number() over (order by md5('42:' || p_partkey), p_partkey) as r from part) where r <= greatest(1, round_even((select count(*) from part) * 0.25, 0))",
    "compound_split": """with c as (select distinct p_brand as cid from part), k as (select cid, row_number() over (order by md5('42:' || cid), cid) as r from c)
select p_partkey as row_id, p_brand as cid from part where p_brand in (select cid from k where r <= greatest(1, round_even((select count(*) from c) * 0.25, 0)))""",
    "lab_splits": f"with {_LAB} select split, count(*) as n, count(distinct target_id) as targets from gold group by split",
    "tfidf_search": f"{_TFIDF} select query_id, target_id, round(score, 6) as score from r where rank <= 5",
    "tfidf_edit_rerank": f"""{_TFIDF}, e as (
  select query_id, target_id, round(0.8 * score + (1 - 0.8) * (1.0 - levenshtein(qq.name, c.name) / greatest(length(qq.name), length(c.name), 1)), 9) as score
  from r join qq on qq.id = query_id join c on c.id = target_id where rank <= 15),
k as (select *, row_number() over (partition by query_id order by score desc, target_id)::int as rank from e) select query_id, target_id, rank, round(score, 6) as score from k where rank <= 5""",
    "features_core": f"with {_LAB}, {_FEATS} select query_id, target_id, rank, " + ", ".join(f"round({c}, 6) as {c}" for c in ("rank_prior", "compact_exact", "char3_jaccard", "token_jaccard", "lipid_signature_match", "lipid_class_match", "stereo_mismatch")) + " from feats",
    "rerank_core": f"with {_LAB}, {_FEATS} select query_id, target_id, new_rank, round(s, 6) as rerank_score from ranked where new_rank <= 5",
    "gold_rank_fallback": f"""with {_LAB}, {_FEATS}, st as (select *, row_number() over (partition by query_id order by s desc, rank, target_id)::int as nr from ranked where q <> t)
select g.query_id, (select min(rank) from nn where nn.query_id = g.query_id and nn.target_id = g.target_id) as base_rank,
  coalesce((select min(nr) from st where st.query_id = g.query_id and st.target_id = g.target_id), (select min(rank) from nn where nn.query_id = g.query_id and nn.target_id = g.target_id)) as gold_rank from gold g""",
    "predictions_core": f"{_ALL} select query_id, split, predicted_target_id, round(prediction_score, 6) as prediction_score, top1_relation_to_query, top1_exact_correct, gold_rank from pred",
    "rank_metrics": f"{_ALL} select split, {_rank_means('gold_rank', (1, 5, 10, 50, 256))} from pred group by split",
    "subset_metrics": f"""{_ALL}, x as (select 'all' as subset, * from pred union all select 'test', * from pred where split = 'test' union all select 'wrong', * from pred where not top1_exact_correct)
select subset, {_rank_means('gold_rank', (1, 5, 10, 50, 256))} from x group by subset""",
    "auto_sweep": f"""{_ALL}, val as (select * from pred where split = 'validation'), {_grid('val', 'score_margin', 101)},
x as (select threshold, {_OK_SCORE} and ({_MARGIN} >= threshold or ({_MARGIN} >= 0.0283 and {_SUPPORTED})) as a, top1_exact_correct as ok from val, grid)
select threshold, count(*) filter (a) as accepted_n, round(avg(ok::int) filter (a), 6) as precision, round(avg(a::int), 6) as coverage from x group by threshold having count(*) filter (a) > 0""",
    "fallback_sweep": f"""{_ALL}, val as (select * from pred where split = 'validation'), {_grid('val', 'score_margin', 101)},
x as (select threshold, {_OK_SCORE} and {_MARGIN} >= threshold as a, coalesce(gold_rank <= 10, false)::int as ok from val, grid)
select threshold, count(*) filter (a) as retained_n, round(avg(ok) filter (a), 6) as retained_hit10, round(avg(a::int), 6) as retained_coverage, count(*) filter (not a) as fallback_n, round(avg(ok) filter (not a), 6) as fallback_hit10 from x group by threshold""",
    "confidence_tiers": f"{_ALL}, {_TIERED} " + _within("confidence_tier", "tiered"),
    "tier_diagnostics": f"""{_ALL}, {_TIERED} select split, confidence_tier, count(*) as n, round(avg(coalesce(1.0 / gold_rank, 0.0)), 6) as mrr,
  round(avg(case when gold_rank <= 1 then 1.0 else 0.0 end), 6) as hit_1, round(avg(case when gold_rank <= 10 then 1.0 else 0.0 end), 6) as hit_10, round(avg(case when gold_rank <= 256 then 1.0 else 0.0 end), 6) as hit_256,
  quantile_cont(gold_rank, 0.5)::double as median_rank, round(avg(score_margin), 6) as mean_margin, round(quantile_cont(score_margin, 0.5), 6) as median_margin from tiered group by split, confidence_tier""",
    "curation_routes": f"""{_ALL}, {_TIERED}, x as (
  select split, case confidence_tier when 'high_confidence_refmet_auto_accept' then 'existing_refmet_auto_accept' when 'medium_confidence_refmet_review' then confidence_tier
    else case when query_id % 4 = 0 then 'manual_review_possible_new_refmet_or_pubchem_candidate' else 'manual_review_low_confidence_no_pubmed_candidate' end end as curation_route from tiered) """ + _within("curation_route", "x"),
    "curve_threshold": f"""{_ALL}, w as (select *, coalesce(score_margin, 0.0) as m from pred where split = 'test'), {_grid('w', 'm', 41)},
x as (select threshold, coalesce(score_margin >= threshold and prediction_score >= 0, false) as a, top1_exact_correct as ok from w, grid)
select threshold, round(avg(a::int), 6) as coverage, count(*) filter (a) as accepted_n, round(avg(ok::int) filter (a), 6) as precision from x group by threshold""",
    "curve_coverage": f"""{_ALL}, w as (select round(coalesce(score_margin, -1e9), 9) as m, query_id, top1_exact_correct::int as ok from pred where split = 'test'),
r as (select *, row_number() over (order by m desc, query_id) as nth, count(*) over () as n from w),
c as (select unnest([1.0, 0.9, 0.75, 0.5, 0.25, 0.1]::double[]) as coverage),
k as (select coverage, greatest(1, round_even(coverage * (select count(*) from w), 0))::bigint as n_answered from c)
select coverage, n_answered, round(avg(ok), 6) as accuracy, min(m) as least_margin from k join r on nth <= n_answered group by coverage, n_answered""",
    "case_groups": f"{_ALL}, x as (select split, {_CASE} as case_group from pred) " + _within("case_group", "x"),
    "review_sample": f"""{_ALL}, x as (select query_id, {_CASE} as case_group from pred where split = 'test'),
r as (select *, row_number() over (partition by case_group order by md5('42:' || query_id), query_id)::int as review_rank from x)
select query_id, case_group, review_rank from r where review_rank <= case when case_group = 'top1_correct' then 50 else 75 end""",
    "open_set": f"""with {_LAB}, {_FEATS}, tst as (select * from gold where split = 'test'),
ids as (select target_id, row_number() over (order by md5('42:' || target_id), target_id) as r, count(*) over () as n from (select distinct target_id from tst)),
held as (select target_id from ids where r <= greatest(1, floor(n * 0.1))), o as (select * from tst where target_id in (select target_id from held)),
rr as (select r.*, row_number() over (partition by r.query_id order by s desc, rank, r.target_id) as nr from ranked r where r.target_id not in (select target_id from held) and r.query_id in (select query_id from o)),
w as (select o.query_id, a.s as prediction_score, round(a.s - b.s, 9) as score_margin from o left join rr a on a.query_id = o.query_id and a.nr = 1 left join rr b on b.query_id = o.query_id and b.nr = 2),
m as (select *, coalesce(score_margin, 0.0) as m from w), {_grid('m', 'm', 31)},
x as (select threshold, coalesce(score_margin >= threshold and prediction_score >= 0.3, false)::int as a from m, grid)
select threshold, count(*) as n_open, round(avg(a), 6) as false_accept_rate, round(avg(1 - a), 6) as abstain_rate from x group by threshold""",
    "strict_audit": f"""with {_LAB}, {_FEATS}, st as (select *, row_number() over (partition by query_id order by new_rank) as sr from ranked where q <> t),
x as (select g.query_id, (select min(sr) from st where st.query_id = g.query_id and st.target_id = g.target_id) as strict_rank from gold g) select {_rank_means('strict_rank', (1, 5, 10))} from x""",
    "leakage_summary": f"""with {_LAB}, {_FEATS}, o as (select query_id, bool_or(q = t) as p, bool_or(q = t and new_rank = 1) as f from ranked group by query_id),
x as (select lab.q = lab.g as same, coalesce(p, false) as p, coalesce(f, false) as f from lab join gold on gold.query_id = query_i and target_id is not null left join o on o.query_id = query_i)
select count(*) as queries, count(*) filter (same) as gold_equals_query, count(*) filter (f) as top1_equals_query, count(*) filter (not same and f) as nonidentical_top1_equals_query, count(*) filter (not same) as nonidentical, count(*) filter (not same and p) as nonidentical_own_in_pool from x""",
    "conservative_audit": f"""{_ALL}, x as (
  select top1_exact_correct as ok, case when q = g and q = coalesce(t, '') then 'gold_and_top1_equal_query' when q = g then 'gold_equals_query' when q = coalesce(t, '') then 'top1_equals_query' else 'kept' end as reason
  from pred join lab on query_i = query_id left join targets on target_id = predicted_target_id) select reason, count(*) as n, round(avg(ok::int), 6) as accuracy from x group by reason""",
    "ablation_core": f"""with {_LAB}, {_FEATS}, a as ({_ablation()}), names as (select distinct trial from a),
x as (
  select n.trial, g.query_id, coalesce(a.r, nn.rank) as gold_rank from names n cross join gold g left join a on a.trial = n.trial and a.query_id = g.query_id and a.target_id = g.target_id
  left join nn on nn.query_id = g.query_id and nn.target_id = g.target_id)
select trial, {_rank_means('gold_rank', (1, 5, 10))} from x group by trial""",
    "positive_pairs": f"""with n as (select distinct p_brand as cid, {n3('p_name')} as name from part), k as (select * from n where {trainable('name')}),
r as (select *, row_number() over (partition by cid order by md5(name || '42'), name) as rn from k), f as (select *, count(*) over (partition by cid) as c from r where rn <= 24)
select a.cid, a.name as anchor, b.name as positive from f a join f b on a.cid = b.cid and b.rn = a.rn % a.c + 1 where a.c >= 2""",
    "event_windows": "select event_type, count(*) as windows, sum(n)::bigint as n from (select event_type, date_trunc('day', ts) as d, count(*) as n from events group by all) group by event_type",
}
