"""Token counts of a corpus for every context limit, from its exact length histogram.

Documents are encoded once and only (length, documents) is shuffled, summed map-side first: at most
one row per distinct length and input split leaves a task, however skewed the lengths are. Suffix
sums over the histogram then answer, for each limit L that some document has exactly or that is asked for:

- ``docs_at_least``: documents of L tokens or more;
- ``tokens_at_least``: their tokens;
- ``truncated_total``: tokens left if every document is cut to L;
- ``docs_at_most`` / ``quantile``: documents of at most L tokens, and their share.

The sums run over ranges of lengths: each range adds what the ranges above it hold, so that no task
sees the whole histogram, which may have as many rows as the corpus has distinct lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.llm.codec import counting_codec
from martlight.llm.common import written

#: Lengths in one range of the suffix sums.
RANGE = 256
#: Context limits that are always answered.
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)


def lengths(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """One row per document: ``n_tokens``. Null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counting_codec(vocabulary)
        for batch in batches:
            _, bounds = own.encode_batch(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds), pa.int64())], names=["n_tokens"])

    return documents.select(text).mapInArrow(run, "n_tokens long")


def histogram(token_counts: DataFrame) -> DataFrame:
    """n_tokens, docs: documents of exactly that length."""
    return token_counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(counts: DataFrame, limits: tuple[int, ...] = ()) -> DataFrame:
    """Answers for every length in the histogram and every one of ``limits``; empty for an empty corpus.

    A limit that no document has exactly is a row with ``docs`` 0.

    The histogram is written first: the sums read it three times, the documents once.
    """
    if limits:
        asked = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("n_tokens"))
        counts = counts.union(asked.withColumn("docs", F.lit(0).cast("long"))).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))
    counts = written(counts, "histogram")
    ranged = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn(
        "range", F.expr(f"n_tokens div {RANGE}")
    )
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # One row per 256 lengths.
    totals = ranged.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "range",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(Window.partitionBy()).alias("all_docs"),
        F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.col("n_tokens").desc())
    docs, tokens = F.col("docs_at_least"), F.col("tokens_at_least")
    return (
        ranged.join(totals.where("all_docs > 0"), "range")
        .withColumn("docs_at_least", F.sum("docs").over(within) + F.col("docs_above"))
        .withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("tokens_above"))
        .select(
            "n_tokens", "docs", "docs_at_least", "tokens_at_least",
            (F.col("all_docs") - docs + F.col("docs")).alias("docs_at_most"),
            ((F.col("all_docs") - docs + F.col("docs")) / F.col("all_docs")).alias("quantile"),
            (F.col("all_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_total"),
        )
    )


def at_limits(counts: DataFrame, limits: list[int]) -> DataFrame:
    """For a list of context limits: documents that reach each, and tokens left after cutting to it."""
    cut = F.explode(
        F.array(*[
            F.struct(F.lit(x).alias("context"), F.least("n_tokens", F.lit(x)).alias("left"), (F.col("n_tokens") >= x).alias("full"))
            for x in limits
        ])
    )
    return counts.select("docs", cut.alias("c")).groupBy("c.context").agg(
        F.sum(F.when(F.col("c.full"), F.col("docs")).otherwise(0)).alias("docs_at_least"),
        F.sum(F.col("c.left") * F.col("docs")).alias("truncated_total"),
    )
