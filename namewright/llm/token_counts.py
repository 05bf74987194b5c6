"""Token counts: exact histogram of encoded lengths, whose suffix sums answer every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import written

#: Lengths a block; sums over blocks come first, so no task sorts the whole histogram.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by the number of ids of their whole text.

    Null and empty texts have 0 tokens; no documents, no rows; repeated rows count each time. Each Arrow batch is summed
    before the shuffle, so a length that a third of all documents have is one row a task.
    """

    def count(batches):
        for batch in batches:
            lengths, n = np.unique(encoder(tokenizer).counts(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], ["n_tokens", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram: documents and tokens of those at least so long, and what is left of all when cut to L.

    docs_at_least, tokens_at_least: suffix sums, L itself included. tokens_at_limit: tokens if every document is cut to L.
    share_within: share of documents that fit L uncut. The histogram is written once, as blocks and lengths both need it.
    """
    h = written(histogram, "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("d").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
        F.sum("t").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"),
    )
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_later") + F.sum("n_docs").over(here)).alias("docs_at_least"),
        (F.col("tokens_later") + F.sum("tokens").over(here)).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_at_limit"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_within"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: docs_cut and tokens_kept when documents are cut to ``limit`` tokens, for any limit; nulls if there are no documents."""
    above: Column = F.col("n_tokens") > limit
    return sums.agg(
        F.sum(F.when(above, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))).alias("tokens_kept"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the smallest length within which at least the share q of the documents fits."""
    return sums.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))
