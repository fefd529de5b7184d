"""Operator 9, token counts by an exact length histogram.

Each document is encoded once and leaves its worker as a number. Documents are then aggregated by length, and suffix
sums over the histogram answer, for any context limit, how many documents and tokens exceed it, what truncation would
keep, and every quantile. Suffix sums run in two levels, slabs of 1024 lengths and lengths within a slab, so that no
task gathers the whole histogram.

Defined results: null text has length 0; texts of any length are encoded whole; repeated rows count each, and documents
of one length share a row; an empty table gives an empty histogram; quantiles of an empty histogram are absent; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, trimmed
from .tokens import default_tokenizer, encoder

SLAB = 1024
MOST_LIMITS = 1000


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.counts(b.column(1)), pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run, encodes=True), "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: documents and tokens up to and over L, and the tokens that
    truncation to L keeps. Limits between two lengths follow from the next shorter row: over is the same, and truncation
    keeps limit - L more tokens for each document over it."""
    h = materialize(histogram, "token-histogram").withColumn("slab", F.floor(F.col("n_tokens") / SLAB))
    tokens = (F.col("n_tokens") * F.col("n_docs")).cast("bigint")
    slabs = h.groupBy("slab").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    after = Window.orderBy(F.col("slab").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = lambda c, w, name: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint").alias(name)
    slabs = slabs.select("slab", sums("docs", after, "docs_after"), sums("tokens", after, "tokens_after"), sums("docs", whole, "all_docs"), sums("tokens", whole, "all_tokens"))
    within = Window.partitionBy("slab").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = h.join(slabs, "slab").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (sums("n_docs", within, "d") + F.col("docs_after")).alias("docs_over"),
        (sums(tokens, within, "t") + F.col("tokens_after")).alias("tokens_over"),
    )
    return rows.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_up_to"),
        "docs_over",
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_up_to"),
        "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_truncated"),
        (F.col("all_docs") - F.col("docs_over")).cast("double").alias("__r") / F.col("all_docs"),
    ).toDF("context_limit", "n_docs", "docs_up_to", "docs_over", "tokens_up_to", "tokens_over", "tokens_truncated", "quantile")


def quantiles(table: DataFrame, of: list[float]) -> DataFrame:
    """p, n_tokens: the least length that at least a share p of the documents don't exceed."""
    aggs = [F.min(F.when(F.col("docs_up_to") >= F.lit(float(p)) * (F.col("docs_up_to") + F.col("docs_over")), F.col("context_limit"))).alias(str(i)) for i, p in enumerate(of)]
    one = table.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(str(i)).alias("n_tokens")) for i, p in enumerate(of)])).alias("x")).select("x.*").where("n_tokens is not null")


def truncated_totals(table: DataFrame, limits: DataFrame) -> DataFrame:
    """limit, tokens: what truncation to each of a few asked limits (a column limit, at most MOST_LIMITS) keeps."""
    if limits.limit(MOST_LIMITS + 1).count() > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits: read them off the context table")
    least = table.select("context_limit", "n_docs")
    kept = F.sum(F.least(F.col("context_limit"), F.col("limit")) * F.col("n_docs")).cast("bigint")
    return F.broadcast(limits).join(least, F.lit(True)).groupBy("limit").agg(kept.alias("tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return context_table(length_histogram(token_lengths(docs, tokenizer)))
