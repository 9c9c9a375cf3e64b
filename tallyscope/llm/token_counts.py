"""Exact length histogram of encoded documents.

Documents are aggregated by encoded length; suffix sums over the histogram then answer, for every context
limit at once: how many documents are longer, how many tokens remain when each is cut at the limit, the
totals and the exact quantiles. The histogram is far smaller than the corpus, and its running sums are taken
within blocks of lengths, then over the blocks, so that no task holds the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm import encoding
from tallyscope.llm.common import rows_of, staged

#: Lengths in one block of the running sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None, column: str = "text") -> DataFrame:
    """One row (`length` bigint) for each document: its number of token ids; null texts have 0.

    Lengths are tallied for each batch before they leave Python, so a row is (length, documents).
    """
    path = vocabulary or encoding.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        enc = encoding.encoder(path)
        for _, texts in rows_of(batches, "text"):
            tally = Counter(len(enc.ids(text)) // 4 for text in texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(tally.keys()), pa.int64()), pa.array(list(tally.values()), pa.int64())], ["length", "n"])

    return docs.select(F.col(column).alias("text")).mapInArrow(run, "length bigint, n bigint")


def histogram(docs: DataFrame, vocabulary: str | None = None, column: str = "text") -> DataFrame:
    """Rows by distinct encoded length, with prefix and suffix sums.

    `length`, `n_docs`, `n_tokens` (of documents of that length), `docs_upto`, `tokens_upto` (that length or
    shorter), `docs_over`, `tokens_over` (longer), `truncated_tokens` (of all documents, each cut at `length`
    tokens), `total_docs`, `total_tokens`. Null and empty texts have length 0; repeated rows count each time;
    an empty table gives no rows; other columns are ignored.
    """
    # written once: two branches read it, and the texts are encoded once
    tallies = staged(encoded_lengths(docs, vocabulary, column).groupBy("length").agg(F.sum("n").alias("n_docs")), "lengths")
    counts = tallies.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        counts.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
            F.sum("d").over(every).alias("total_docs"),
            F.sum("t").over(every).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.join(blocks, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_upto"),
        (F.col("tokens_before") + F.sum("n_tokens").over(inside)).alias("tokens_upto"),
        "total_docs",
        "total_tokens",
    )
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_upto",
        "tokens_upto",
        (F.col("total_docs") - F.col("docs_upto")).alias("docs_over"),
        (F.col("total_tokens") - F.col("tokens_upto")).alias("tokens_over"),
        (F.col("tokens_upto") + F.col("length") * (F.col("total_docs") - F.col("docs_upto"))).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents don't exceed, from a histogram; one row, null if empty."""
    return hist.filter((F.col("docs_upto") >= F.lit(q) * F.col("total_docs")) & (F.col("docs_upto") > 0)).agg(F.min("length").alias("length"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens that remain if each document is cut at `limit` tokens; one row, 0 if empty."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))
