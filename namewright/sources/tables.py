"""Sources with explicit schemas, and sinks. CSV columns are strings; malformed rows are dropped; nulls become empty where names are read."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

LAB_NAMES = ("metabolite_name", "metabolite", "name", "compound_name")
LABEL_NAMES = ("refmet_name", "refmet", "refmet name", "common_name", "name")
ID_NAMES = ("refmet_id", "id")
CID_NAMES = ("refmet_cid", "pubchem_cid", "cid")


def detect_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of ``names`` that is a column, in any case."""
    by = {c.lower(): c for c in reversed(columns)}
    return next((by[n] for n in names if n in by), None)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All-string CSV; with ``columns`` the schema is given, not inferred, and rows of other shape are dropped."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("escape", '"')
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_synonym_csv(spark: SparkSession, path: str, columns: list[str], cid_col: str = "cid", name_col: str = "name", **options) -> DataFrame:
    raw = read_csv(spark, path, columns).select(F.col(cid_col).alias("cid"), F.col(name_col).alias("name"))
    return synonyms(raw.withColumn("row_id", F.monotonically_increasing_id()), **options)


def synonyms(raw: DataFrame, dialect: str | None = "n0", filter_empty: bool = True, remove_singletons: bool = True) -> DataFrame:
    """row_id, cid, original_name, name, cid_size of raw (row_id, cid, name): normalised, without empty names, null cids and singletons."""
    name = T.normalize(F.col("name"), dialect) if dialect else F.coalesce(F.col("name"), F.lit(""))
    rows = raw.select("row_id", F.col("cid").cast("string").alias("cid"), F.col("name").alias("original_name"), name.alias("name")).filter("cid is not null")
    if filter_empty:
        rows = rows.filter("name <> ''")
    rows = with_cid_size(rows)
    return rows.filter("cid_size >= 2") if remove_singletons else rows


def with_cid_size(rows: DataFrame) -> DataFrame:
    """Counts by a partial aggregation and a join, so that a large cid doesn't meet in one task."""
    sizes = rows.groupBy("cid").agg(F.count("*").cast("int").alias("cid_size"))
    return rows.join(sizes, "cid")


def describe(rows: DataFrame) -> DataFrame:
    """Row-weighted size statistics."""
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("cid").alias("n_cids"),
        F.min("cid_size").cast("long").alias("min_size"),
        F.max("cid_size").cast("long").alias("max_size"),
        F.avg("cid_size").alias("mean_size"),
        F.percentile("cid_size", F.lit(0.5)).alias("median_size"),
    )


def lab(raw: DataFrame, row_id: str = "query_i", dialect: str = "n1") -> DataFrame:
    """Lab rows with trimmed names, normalised and compact twins and presence flags; missing columns are empty."""
    name, label = detect_column(raw.columns, LAB_NAMES), detect_column(raw.columns, LABEL_NAMES)
    if not name:
        raise ValueError(f"no column of names among {raw.columns}")
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c else F.lit("")
    rows = raw.select(F.col(row_id).cast("long").alias("query_i"), trimmed(name).alias("metabolite_name"), trimmed(label).alias("refmet_name"))
    rows = rows.withColumns({"metabolite_normalized": T.normalize(F.col("metabolite_name"), dialect), "refmet_normalized": T.normalize(F.col("refmet_name"), dialect)})
    return rows.withColumns(
        {
            "metabolite_compact": T.compact(F.col("metabolite_normalized")),
            "refmet_compact": T.compact(F.col("refmet_normalized")),
            "has_metabolite_name": F.col("metabolite_name") != "",
            "has_refmet_name": F.col("refmet_name") != "",
        }
    )


def targets(names: DataFrame, dialect: str = "n1") -> DataFrame:
    """target_id, refmet_name, refmet_id, refmet_cids, refmet_normalized, refmet_compact of names (position, refmet_name, ...): of names
    normalised alike the first by position; ids by position."""
    have = names.columns
    rows = names.select(
        "position",
        "refmet_name",
        (F.col("refmet_id") if "refmet_id" in have else F.lit("")).alias("refmet_id"),
        (T.parse_cids(F.col("refmet_cid")) if "refmet_cid" in have else F.array().cast("array<string>")).alias("refmet_cids"),
        T.normalize(F.col("refmet_name"), dialect).alias("refmet_normalized"),
    ).filter("refmet_normalized <> ''")
    first = rows.groupBy("refmet_normalized").agg(F.min_by(F.struct("position", "refmet_name", "refmet_id", "refmet_cids"), F.col("position")).alias("f")).select("f.*", "refmet_normalized")
    return first.select(dense_id("position").alias("target_id"), "refmet_name", "refmet_id", "refmet_cids", "refmet_normalized", T.compact(F.col("refmet_normalized")).alias("refmet_compact"))


def dense_id(*order) -> Column:
    """0, 1, 2, ... by order: for vocabularies, not for corpora; those take ids by numbered_by."""
    return (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")


def numbered_by(rows: DataFrame, key: str, id_name: str) -> DataFrame:
    """Dense ids in order of a key without one task that sees all rows: numbers within range partitions plus prefix sums."""
    parts = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__row", F.monotonically_increasing_id())
    parts = parts.withColumns({"__part": F.shiftright("__row", 33), "__nth": F.col("__row").bitwiseAND((1 << 33) - 1)})
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return parts.join(counts, "__part").withColumn(id_name, F.col("__base") + F.col("__nth")).drop("__part", "__nth", "__row", "__base")


def read_metric_runs(spark: SparkSession, pattern: str, kind: str = "json") -> DataFrame:
    """Metric files of many runs, united by column name, with the run's folder."""
    rows = spark.read.option("multiLine", True).json(pattern) if kind == "json" else spark.read.option("header", True).csv(pattern)
    return rows.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_record(df: DataFrame, path: str) -> None:
    """A frame of one row (metrics) as a JSON file."""
    row = df.first()
    Path(path).write_text(json.dumps(row.asDict(recursive=True) if row else {}, indent=2, default=str))
