"""Surface corpora: condensation, unique surfaces, identifier maps, name mapping, training groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def condense(raw: DataFrame, per_cid: int = 20) -> DataFrame:
    """The best names of each cid: normalised (n3), distinct, scored, ranked. raw: (cid, name)."""
    rows = raw.filter("cid is not null and name is not null").select(F.col("cid").cast("string").alias("cid"), F.trim("name").alias("display_name"))
    rows = rows.withColumn("normalized_name", T.normalize(F.col("display_name"), "n3")).filter("normalized_name <> ''")
    rows = rows.groupBy("cid", "normalized_name").agg(F.min("display_name").alias("display_name"))
    rows = rows.withColumns({"compact_name": T.compact(F.col("normalized_name")), "name_len": F.length("normalized_name"), "quality_score": T.quality_score(F.col("normalized_name"))}).filter(F.length("compact_name") > 1)
    best = Window.partitionBy("cid").orderBy(F.desc("quality_score"), "name_len", "normalized_name")
    rows = rows.withColumn("cid_name_rank", F.row_number().over(best)).filter(F.col("cid_name_rank") <= per_cid)
    return rows.select("cid", "display_name", "normalized_name", "compact_name", "name_len", "quality_score", "cid_name_rank")


def condensed_summary(condensed: DataFrame) -> DataFrame:
    return condensed.agg(F.count("*").alias("n_rows"), F.countDistinct("cid").alias("n_cids"), F.countDistinct("normalized_name").alias("n_names"), F.max("cid_name_rank").cast("long").alias("most_names"))


def unique_surfaces(raw: DataFrame) -> DataFrame:
    """Distinct normalised names with the least display name and the sorted cids; raw: (cid, name)."""
    rows = raw.filter("cid is not null").select(F.col("cid").cast("string").alias("cid"), F.trim("name").alias("display"), T.normalize(F.col("name"), "n3").alias("normalized_name")).filter("normalized_name <> ''")
    out = rows.groupBy("normalized_name").agg(F.min("display").alias("display_name"), F.sort_array(F.collect_set("cid")).alias("candidate_cids"))
    return out.withColumn("n_candidate_cids", F.size("candidate_cids"))


def surface_summary(surfaces: DataFrame) -> DataFrame:
    return surfaces.agg(F.count("*").alias("n_surfaces"), F.count_if(F.col("n_candidate_cids") > 1).alias("n_ambiguous"), F.max("n_candidate_cids").cast("long").alias("most_cids"))


def global_surfaces(condensed: DataFrame, limit: int | None = None) -> DataFrame:
    """Condensed names over all cids, best first; with a limit the first of them (a top-k report)."""
    out = condensed.groupBy("normalized_name").agg(F.min("display_name").alias("display_name"), F.array_join(F.sort_array(F.collect_set("cid")), "|").alias("candidate_cids"), F.min("name_len").alias("name_len"), F.max("quality_score").alias("quality_score"))
    out = out.withColumn("compact_name", T.compact(F.col("normalized_name")))
    return out.orderBy(F.desc("quality_score"), "name_len", "normalized_name").limit(limit) if limit else out


def targeted_lookup(reference: DataFrame, wanted: DataFrame) -> DataFrame:
    """cids of the wanted normalised names in a reference scan: a semi-join, then a set a name. reference: (cid, name), wanted: (normalized_name)."""
    rows = reference.select(F.col("cid").cast("string").alias("cid"), T.normalize(F.col("name"), "n3").alias("normalized_name"))
    hit = rows.join(wanted.select("normalized_name").distinct(), "normalized_name", "left_semi")
    return hit.groupBy("normalized_name").agg(F.sort_array(F.collect_set("cid")).alias("cids"))


def attach_cids(targets: DataFrame, lookup: DataFrame) -> DataFrame:
    """Targets with their own cids, else those of the lookup."""
    found = lookup.select(F.col("normalized_name").alias("refmet_normalized"), F.col("cids").alias("found"))
    own = F.when(F.size("refmet_cids") > 0, F.col("refmet_cids"))
    return targets.join(found, "refmet_normalized", "left").withColumn("refmet_cids", F.coalesce(own, "found", F.array().cast("array<string>"))).drop("found")


def compact_matches(targets: DataFrame, surfaces: DataFrame, most: int = 25) -> DataFrame:
    """(target_id, normalized_name) with equal compact keys; targets with more than ``most`` matches have none."""
    t = targets.select("target_id", F.col("refmet_compact").alias("key")).filter("key <> ''")
    s = surfaces.select("normalized_name", "candidate_cids", T.compact(F.col("normalized_name")).alias("key"))
    rows = t.join(s, "key")
    sizes = rows.groupBy(F.col("target_id").alias("t")).agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return rows.join(sizes, F.col("target_id") == F.col("t"), "left_semi").select("target_id", "normalized_name", "candidate_cids")


def best_mappings(targets: DataFrame, surfaces: DataFrame, names: int = 20) -> DataFrame:
    """For each target the surfaces that its best name variant meets: method, names, cids."""
    v = targets.select("target_id", F.explode(T.name_variants(F.col("refmet_normalized"))).alias("v")).select("target_id", "v.*")
    exact = v.join(surfaces.select(F.col("normalized_name").alias("value"), "candidate_cids"), "value").select("target_id", "priority", "method", F.col("value").alias("mapped"), "candidate_cids")
    loose = compact_matches(targets, surfaces).select("target_id", F.lit(len(T.VARIANTS)).alias("priority"), F.lit("compact_key").alias("method"), F.col("normalized_name").alias("mapped"), "candidate_cids")
    rows = exact.unionByName(loose)
    best = rows.groupBy(F.col("target_id").alias("t")).agg(F.min("priority").alias("p"))
    rows = rows.join(best, (F.col("target_id") == F.col("t")) & (F.col("priority") == F.col("p")))
    out = rows.groupBy("target_id").agg(F.min("method").alias("method"), F.slice(F.sort_array(F.collect_set("mapped")), 1, names).alias("mapped_names"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("candidate_cids")))).alias("cids"))
    return out.withColumn("n_cids", F.size("cids"))


def mapping_status(lab: DataFrame, surfaces: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each lab row over its name columns: the cids that any of them meets and whether none, one or several.

    Both joins are merges: either side grows with the corpus, and by the size of its files Spark would broadcast lists of cids a row.
    """
    long = lab.select("query_i", F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("name")) for c in columns])).alias("x")).select("query_i", "x.*")
    long = long.withColumn("normalized_name", T.normalize(F.col("name"), "n3")).filter("normalized_name <> ''")
    hits = long.join(surfaces.hint("merge"), "normalized_name").groupBy("query_i").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("candidate_cids")))).alias("cids"), F.sort_array(F.collect_set("source")).alias("sources"))
    n = F.coalesce(F.size("cids"), F.lit(0))
    out = lab.select("query_i").join(hits.hint("merge"), "query_i", "left").withColumn("n_cids", F.when(F.col("cids").isNull(), 0).otherwise(n))
    return out.withColumn("mapping_status", F.when(F.col("n_cids") == 0, "unmatched").when(F.col("n_cids") == 1, "exact_unique_cid").otherwise("exact_ambiguous_cid"))


def cid_groups(raw: DataFrame, most: int = 24, seed: int = 42) -> DataFrame:
    """Training groups: up to ``most`` names a cid in md5 order, of cids with two or more; (cid, names, n_names, hard_key)."""
    rows = raw.filter("cid is not null").select(F.col("cid").cast("string").alias("cid"), T.normalize(F.col("name"), "n3").alias("name")).filter(T.trainable(F.col("name"))).distinct()
    order = Window.partitionBy("cid").orderBy(F.md5(F.concat("name", F.lit(str(seed))).cast("binary")), "name")
    rows = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    out = rows.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("names"), F.count("*").alias("n_names"), F.min("name").alias("first")).filter("n_names >= 2")
    return out.select("cid", "names", "n_names", T.hard_key_text(F.col("first")).alias("hard_key"))


def hash_split(rows: DataFrame, key: str, validation: float = 0.05) -> DataFrame:
    """train or validation by md5 of the key."""
    value = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000
    return rows.withColumn("split", F.when(value < int(validation * 1_000_000), "validation").otherwise("train"))


def hard_negatives(rows: DataFrame, n: int = 1, prefix: int = 4) -> DataFrame:
    """For each row the first n rows of its hard-key bucket with another cid, in md5 order. rows: (row_id, cid, name).

    Each bucket keeps its first n + 1 rows of each of its first n + 1 cids, which suffices for every row, so no bucket is paired with itself.
    """
    key = T.hard_key(F.col("name"), prefix)
    order = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    k = rows.select("row_id", "cid", key.alias("bucket"), order("row_id").alias("o"))
    per_cid = Window.partitionBy("bucket", "cid").orderBy("o", "row_id")
    few = k.withColumn("r", F.row_number().over(per_cid)).filter(F.col("r") <= n)
    firsts = few.groupBy("bucket", "cid").agg(F.min(F.struct("o", "row_id")).alias("f"))
    firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("f"))).filter(F.col("r") <= n + 1).select("bucket", "cid")
    pool = few.join(firsts, ["bucket", "cid"], "left_semi").select(F.col("bucket").alias("b"), F.col("cid").alias("c"), F.col("row_id").alias("negative_id"), F.col("o").alias("no"))
    pairs = k.join(pool, (F.col("bucket") == F.col("b")) & (F.col("cid") != F.col("c")))
    best = Window.partitionBy("row_id").orderBy("no", "negative_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("row_id", "negative_id", "rank")


def positive_pairs(groups: DataFrame) -> DataFrame:
    """(cid, anchor, positive): each name of a group with the next, the last with the first."""
    at = F.posexplode("names").alias("i", "anchor")
    rows = groups.select("cid", "names", at)
    return rows.select("cid", "anchor", F.element_at("names", ((F.col("i") + 1) % F.size("names") + 1).cast("int")).alias("positive"))


def triplets(rows: DataFrame, prefix: int = 4) -> DataFrame:
    """(anchor_id, positive_id, negative_id): the next row of the cid and a hard negative, null if the bucket has no other cid."""
    order = Window.partitionBy("cid").orderBy("row_id")
    nxt = F.coalesce(F.lead("row_id").over(order), F.first("row_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pos = rows.select(F.col("row_id").alias("anchor_id"), nxt.alias("positive_id")).filter("anchor_id <> positive_id")
    neg = hard_negatives(rows, 1, prefix).select(F.col("row_id").alias("anchor_id"), "negative_id")
    return pos.join(neg, "anchor_id", "left")
