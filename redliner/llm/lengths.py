"""Token counts: the exact histogram of encoded lengths.

Documents are aggregated by encoded length.  From one row for each length, sums from both ends answer, for every context
limit at a length, how many documents fit, how many tokens the corpus has, how many are left when
documents are cut at the limit, and the share of documents at or below it (a quantile's inverse).

Defined results: a null or empty text has length 0 before the end ids; repeated rows count each time; an
empty table gives no rows; only the text column is read.  The histogram has one row for each distinct
length, at most the longest document's length, so its running sums over one ordered task are bounded
by that, not by the corpus.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redliner.llm.tokens import encoder as worker_encoder
from redliner.llm.tokens import tokenizer_path


def encoded_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(length)``, the number of ids of every document's whole text."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = worker_encoder(path)
        for batch in batches:
            size = encoder.dtype.itemsize
            found = [len(encoder.encode(t)) // size for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["length"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row for each length: its documents, and what a context limit of that length would give."""
    counts = encoded_lengths(docs, text_col, path).groupBy("length").agg(F.count("*").alias("n_docs"))
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("length") * F.col("n_docs")
    return (
        counts.withColumn("docs_within", F.sum("n_docs").over(up))
        .withColumn("tokens_within", F.sum(tokens).over(up))
        .withColumn("all_docs", F.sum("n_docs").over(whole))
        .withColumn("all_tokens", F.sum(tokens).over(whole))
        .select(
            "length",
            "n_docs",
            "docs_within",
            "tokens_within",
            (F.col("all_docs") - F.col("docs_within")).alias("docs_beyond"),
            (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_beyond"),
            (F.col("tokens_within") + F.col("length") * (F.col("all_docs") - F.col("docs_within"))).alias(
                "tokens_truncated"
            ),
            (F.col("docs_within") / F.col("all_docs")).alias("share_within"),
        )
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the least length at or below which that share of documents lies."""
    wanted = histogram.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return (
        histogram.join(F.broadcast(wanted), histogram["share_within"] >= wanted["share"])
        .groupBy("share")
        .agg(F.min("length").alias("length"))
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, docs_within, tokens_truncated)`` for any context limits, also those between lengths."""
    wanted = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "`limit` long")
    cut = F.least("length", "limit") * F.col("n_docs")
    return (
        histogram.join(F.broadcast(wanted))
        .groupBy("limit")
        .agg(
            F.sum(F.when(F.col("length") <= F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_within"),
            F.sum(cut).alias("tokens_truncated"),
        )
    )
