"""Operator 8, exact dedup by content sort.

Native: DataFrame expressions only. Neighbours in sorted order decide.

1. Texts range-partition by splitters that Spark samples. Splitters pass through the driver, so they are of bounded
   length: the first characters of the normalised text, then a hash of all of it where texts begin alike.
2. Each partition sorts externally by content, so that equal texts stand side by side. A row whose whole text differs
   from its neighbour's before it opens a run; the first of a run, by length and doc_id, is its keeper.
3. A text of which a sample shows more rows than a partition's fair share would fill a partition of its own: the sample
   gives it a number of salts, and it alone is dealt over several ranges. The keepers of its runs, a row for each
   salt, are sorted by content and compared with their neighbours in the same way, and carry the least over the splits.

Texts cross the network once. A sample that misses a hot text costs time, not results.

Defined results: null text is empty, and all texts of white space alone are equal; of equal texts the row with the
most code points in the original stays, then the smallest doc_id (null last), and of repeated rows just one; texts of
any length are compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialize, shuffle_partitions, text_of

#: Sampled rows for each partition, on average.
SAMPLE = 200


def _normalised(docs: DataFrame, prefix_chars: int) -> DataFrame:
    text = text_of()
    rows = docs.select(F.col("doc_id"), F.length(text).alias("chars"), F.translate(text, SPACES, "").alias("norm"))
    return rows.select("*", F.substring("norm", 1, prefix_chars).alias("prefix"), F.xxhash64("norm").alias("h"))


def hot_texts(docs: DataFrame, n: int, prefix_chars: int) -> DataFrame:
    """hot (hash of a text) and salts, for texts that a sample gives more than half a partition's share; 2 n at most."""
    total = docs.select(F.lit(1)).count()
    share = min(1.0, SAMPLE * n / max(total, 1))
    sampled = _normalised(docs if share == 1.0 else docs.sample(share, seed=8), prefix_chars).groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    rows = max(total * share, 1.0)
    found = sampled.where(F.col("k") > max(rows / (2 * n), 8.0)).orderBy(F.col("k").desc(), "h").limit(2 * n)
    return materialize(found.select(F.col("h").alias("hot"), (F.ceil(F.col("k") * (2 * n / rows)) + 1).cast("int").alias("salts")), "hot-texts")


def _opens(order: Window) -> Column:
    """Whether a row's whole text differs from its neighbour's before it."""
    return ~F.col("norm").eqNullSafe(F.lag("norm").over(order))


def exact_dedup(docs: DataFrame, prefix_chars: int = 24) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    hot = F.broadcast(hot_texts(docs, n, prefix_chars))  # 2 n rows at most
    keyed = _normalised(docs, prefix_chars).join(hot, F.col("h") == F.col("hot"), "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id", "chars"), F.col("salts"))).otherwise(-1).cast("int")
    ranged = keyed.select("doc_id", "chars", "norm", "prefix", "h", salt.alias("salt")).repartitionByRange(n, "prefix", "h", "salt")

    # The range partitioning clusters these keys already: no further exchange, only the external sort.
    best = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    by_content = Window.partitionBy("prefix", "h", "salt").orderBy("norm", *best)
    so_far = by_content.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    neighbours = ranged.withColumn("opens", _opens(by_content))
    numbered = neighbours.select(
        "doc_id",
        "chars",
        "prefix",
        "h",
        "salt",
        "opens",
        F.sum(F.col("opens").cast("int")).over(so_far).alias("run"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        # The texts of keepers alone go on, for the runs of split texts.
        F.when(F.col("opens") & (F.col("salt") >= 0), F.col("norm")).alias("norm"),
    )
    one_run = Window.partitionBy("prefix", "h", "salt", "run")
    keeper = F.max(F.when(F.col("opens"), F.struct("doc_id"))).over(one_run)
    runs = numbered.select("*", keeper["doc_id"].alias("run_keeper"), F.count(F.lit(1)).over(one_run).alias("run_size"))
    rows = materialize(runs, "exact-dedup")

    # Runs of split texts: a row for each salt.
    heads = rows.where("opens and salt >= 0").select("h", "salt", "run", "norm", "chars", F.col("run_keeper").alias("doc_id"), "run_size")
    again = Window.partitionBy("h").orderBy("norm", *best, "salt")
    merged = heads.withColumn("first", _opens(again)).withColumn("text", F.sum(F.col("first").cast("int")).over(again.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one_text = Window.partitionBy("h", "text")
    merged = merged.select(
        F.col("h").alias("mh"),
        F.col("salt").alias("ms"),
        F.col("run").alias("mr"),
        F.max(F.when(F.col("first"), F.struct("doc_id"))).over(one_text)["doc_id"].alias("all_keeper"),
        F.sum("run_size").over(one_text).alias("all_size"),
        "first",
    )
    split = rows.where("salt >= 0").join(merged, (F.col("h") == F.col("mh")) & (F.col("salt") == F.col("ms")) & (F.col("run") == F.col("mr")))
    whole = rows.where("salt < 0").select("doc_id", F.col("run_keeper").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("opens").alias("kept"), "text_sha256")
    parts = split.select("doc_id", F.col("all_keeper").alias("keep_id"), F.col("all_size").alias("group_size"), (F.col("opens") & F.col("first")).alias("kept"), "text_sha256")
    return whole.unionByName(parts)
