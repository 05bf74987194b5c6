"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: White space, or a word with its first character set apart.
WORDS = r"[\x20\x09-\x0D]+|([^\x20\x09-\x0D])[^\x20\x09-\x0D]*"
#: Order values of a source's documents have 48 bits; sums over their upper 12 come first, then over the next 12 of one bucket, then documents.
LOW_BITS = (36, 24, 0)


def order_value(doc_id: Column, seed: int) -> Column:
    """Seeded order of documents, 48 bits; md5, so that other engines can repeat it. A null doc_id counts as -1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-1"))).cast("binary")), 1, 12), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Number of words; null has none. Words shrink to a character each, so a long text makes no list of all its words."""
    return F.coalesce(F.length(F.regexp_replace(text.cast("string"), WORDS, "$1")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources (source, source_size) with target: all words shared by weight, none above ``epochs`` times its size.

    Sources by code point, null last, take the weights in turn. In order of the share at which they fill up, a source is
    capped if its part of what is left would exceed its cap; the integers compared are exact (decimal).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    s = sources.select("source", "source_size", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * epochs).alias("cap"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    total = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(38,0)")
    s = s.withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    s = s.withColumn("capped", big(F.col("left")) * F.col("w") > big(F.col("cap")) * F.col("w_left"))
    free = F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("w"))).over(total)
    rest = F.sum("source_size").over(total) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(total)
    share = (F.col("w") * rest).cast("double") / F.nullif(free, F.lit(0)).cast("double")
    return s.select("source", "source_size", F.when(F.col("capped") | (F.col("source_size") == 0), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan_mix(sized: DataFrame, epochs: int = 3) -> DataFrame:
    """(plan_source, source_size, target, whole, upto): documents are taken ``whole`` times, those with order value up to ``upto`` once more.

    sized: (source, size, h). ``upto`` is where the words so far come nearest to what is missing. It is found among sums by the
    order's upper bits, then among those of one bucket by the next bits, then among the documents of one such bucket: no task
    sees more than 4096 sums of a source, nor its documents together. Rows a source are few: sources are ordered in one task.
    """
    sums = lambda rows, low, *by: rows.groupBy(*by, F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("size"))
    top = written(sums(sized, LOW_BITS[0], "source"), "sums")
    sources = water_fill(top.groupBy("source").agg(F.sum("size").alias("source_size")), epochs)
    whole = F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(epochs))
    goal = sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = written(goal.withColumnRenamed("source", "s"), "goal")
    edge, ends = goal.select("s", F.lit(0).cast("long").alias("before"), "missing"), []
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for k, low in enumerate(LOW_BITS):
        if k:
            inside = sized.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", LOW_BITS[k - 1]) == F.col("found")))
            sized = inside.select("source", "size", "h")
            rows = sums(inside, low, "s", "before", "missing")
        else:
            rows = top.join(edge, F.col("source").eqNullSafe(F.col("s"))).select("s", "before", "missing", "bucket", "size")
        rows = rows.withColumn("cum", F.col("before") + F.sum("size").over(upto))
        if low:
            edge = rows.filter((F.col("cum") >= F.col("missing")) & (F.col("cum") - F.col("size") < F.col("missing")))
            edge = written(edge.select("s", (F.col("cum") - F.col("size")).alias("before"), "missing", F.col("bucket").alias("found")), "edge")
            ends.append(edge.select("s", (F.shiftleft("found", low) - 1).alias("h"), F.abs(F.col("before") - F.col("missing")).alias("off")))
        else:
            ends.append(rows.select("s", F.col("bucket").alias("h"), F.abs(F.col("cum") - F.col("missing")).alias("off")))
    chosen = ends[-2].unionByName(ends[-1]).groupBy(F.col("s").alias("c")).agg(F.min(F.struct("off", "h")).alias("best"))
    out = goal.join(chosen, F.col("s").eqNullSafe(F.col("c")), "left")
    return out.select(F.col("s").alias("plan_source"), "source_size", "target", "whole", F.coalesce(F.col("best.h"), F.lit(-1)).alias("upto"))


#: Sources up to which the plan is broadcast; beyond it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if few else plan, F.col("__source").eqNullSafe(F.col("plan_source")))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return written(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), order_value(F.col("doc_id"), seed).alias("h")), "sizes")


def _times() -> Column:
    return F.col("whole") + F.when(F.col("__h") <= F.col("upto"), 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 17, epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source; other columns are ignored).

    Null texts have size 0; null is a source of its own; a source without words has target 0; repeated rows of a doc_id are
    taken alike; no documents, no rows. What a source's documents give differs from its target by half a document at most.
    """
    sized = _sized(docs, seed)
    plan = written(plan_mix(sized.select("source", "size", "h"), epochs), "plan")
    out = _with_plan(sized.select("doc_id", "size", F.col("h").alias("__h"), F.col("source").alias("__source")), plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def repeat_rows(docs: DataFrame, seed: int = 17, epochs: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns. Rows without words stay once: they take nothing.

    Nulls, repeated rows and empty tables as in ``mix``; names of further columns don't matter.
    """
    plan = written(plan_mix(_sized(docs, seed).select("source", "size", "h"), epochs), "plan")
    names = [f"__{i}" for i in range(len(docs.columns))]
    col = lambda name: F.col(names[docs.columns.index(name)])
    keyed = docs.toDF(*names).withColumns({"__source": col("source").cast("string"), "__h": order_value(col("doc_id"), seed), "__size": words(col("text"))})
    times = F.when(F.col("__size") == 0, 1).otherwise(_times()).cast("int")
    return _with_plan(keyed, plan).withColumn("__n", F.explode(F.array_repeat(F.lit(0), times))).select(*names).toDF(*docs.columns)
