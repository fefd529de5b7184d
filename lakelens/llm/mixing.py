"""Operator 10, mixing sources to target weights by Poisson replication.

The size of each source is counted over all documents; its repetition rate is target share x target size / own size.
A uniform number from a seeded hash of the doc_id inverts the Poisson distribution with that mean, the document is
exploded by the count, and copies are ordered globally by a seeded hash through a range partitioning.

The inverse is a table of thresholds per source, one row each, which runs to where the upper tail is below 1e-9.

Defined results: a null source is a source of its own; null text has size 0; a null doc_id hashes as empty; repeated
rows get the same count each; a source whose weight or size is 0 gets rate 0; texts of any length count whole; copies of
equal keys follow each other in any order; an empty table gives an empty result; all columns of the input return, and
own columns take the names given, with `_` behind them where the input has such a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import materialize, shuffle_partitions, text_of

#: A join side with more rows, or thresholds in all, than this isn't broadcast.
BROADCAST_ROWS = 50_000
BROADCAST_NUMBERS = 1_000_000


def uniform(*cols: Column | str, seed: str) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an MD5, which other engines can repeat."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(16**13))


def poisson_thresholds(rates: DataFrame) -> DataFrame:
    """of, cdf for each row (of, rate): P(X <= 0), P(X <= 1), ... up to a negligible tail; X >= k exactly when the uniform
    number exceeds threshold k - 1. Terms and their sums are running sums over the numbers of copies of a source."""
    held = rates.select(F.struct("of").alias("key"), "rate")
    top = F.ceil(F.col("rate") + 8 * F.sqrt("rate") + 20).cast("int")
    steps = held.where("rate > 0").select("key", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    so_far = Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))).over(so_far)
    sums = steps.select("key", "k", log.alias("log")).select("key", "k", F.sum(F.exp("log")).over(so_far).alias("c"))
    cdf = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("x")).select(F.col("key.of").alias("of"), F.col("x.c").alias("cdf"))
    return cdf.unionByName(held.where("rate <= 0").select(F.col("key.of").alias("of"), F.array(F.lit(1.0)).alias("cdf")))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: float | None = None, unit: str = "chars") -> DataFrame:
    """source, size, share, rate. Without weights, shares follow size ** power (power 1 keeps the mix, 0 makes it even)."""
    spark = docs.sparkSession
    size = F.length(text_of()).cast("bigint") if unit == "chars" else F.lit(1).cast("bigint")
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(float(power))))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, weight double")
        sizes = sizes.join(F.broadcast(given) if len(weights) <= BROADCAST_ROWS else given, F.col("mix_source").eqNullSafe(F.col("k")), "left").drop("k").fillna(0.0, ["weight"])
    sizes = materialize(sizes, "mix-sizes")
    sums = sizes.agg(F.sum("weight").alias("w"), F.sum("size").alias("s")).first()
    all_weight, all_size = sums["w"] or 1.0, sums["s"] or 0.0
    wanted = F.col("weight") / all_weight * (all_size if total is None else float(total))
    rate = F.when((F.col("size") > 0) & (F.col("weight") > 0), wanted / F.col("size")).otherwise(0.0)
    return sizes.select("mix_source", "size", (F.col("weight") / all_weight).alias("share"), rate.alias("rate"))


def _copies(docs: DataFrame, weights: dict[str | None, float] | None, power: float, total: float | None, unit: str, seed: str) -> DataFrame:
    """row (a struct of all input columns, whatever their names), copy (from 1) and key, in the order of the key."""
    spark = docs.sparkSession
    rates = materialize(poisson_thresholds(source_rates(docs, weights, power, total, unit).select(F.col("mix_source").alias("of"), "rate")), "mix-thresholds")
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cdf")).alias("numbers")).first()
    few = size["n"] <= BROADCAST_ROWS and (size["numbers"] or 0) <= BROADCAST_NUMBERS
    side = F.broadcast(rates) if few else rates.hint("merge")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # The uniform number is evaluated once for each document, not once for each threshold.
    drawn = let(uniform(F.col("row.doc_id"), seed=seed), lambda u: F.size(F.filter("cdf", lambda c: c < u)))
    counted = rows.join(side, F.col("row.source").eqNullSafe(F.col("of"))).select("row", drawn.alias("n")).where("n > 0")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.select("row", "copy", uniform(F.col("row.doc_id"), F.col("copy"), seed=seed + "-order").alias("key"))
    return keyed.repartitionByRange(shuffle_partitions(spark), "key").sortWithinPartitions("key")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: float | None = None, unit: str = "chars", seed: str = "mix-1", copy_col: str = "mix_copy", key_col: str = "mix_key") -> DataFrame:
    """All input columns, plus the copy's number from 1 and its place key in (0, 1); rows come in the order of the key."""
    names = []
    for name in (copy_col, key_col):
        while name.lower() in {c.lower() for c in (*docs.columns, *names)}:
            name += "_"
        names.append(name)
    return _copies(docs, weights, power, total, unit, seed).select("row.*", F.col("copy").alias(names[0]), F.col("key").alias(names[1]))


def mixed_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: float | None = None, unit: str = "chars", seed: str = "mix-1") -> DataFrame:
    """The copies with the input's columns alone, in the same order."""
    return _copies(docs, weights, power, total, unit, seed).select("row.*")
