"""Exact quantiles of groups of any size: values are counted first, and places are found on running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _placed(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, v, m, upto, n: each distinct value of each group with its count, how many values are no greater, and the
    group's size.

    Counts are combined before their shuffle and dealt by ranges of (keys, v), so a large group spreads over many tasks;
    running sums are taken within each range, and those of whole ranges, a row for each range and group, are added.
    """
    named = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("k0")]
    ks = [f"k{i}" for i in range(len(named))]
    counted = df.select(*named, value.alias("v")).where("v is not null").groupBy(*ks, "v").agg(F.count(F.lit(1)).alias("m"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counted.repartitionByRange(n, *ks, "v").withColumn("range", F.spark_partition_id()), "value-counts")
    sums = ranged.groupBy("range", *ks).agg(F.sum("m").alias("s"))
    before = sums.select(F.col("range").alias("r"), *[F.col(k).alias(f"b{k}") for k in ks], (F.sum("s").over(Window.partitionBy(*ks).orderBy("range")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy(*ks)).alias("n"))
    same = F.col("range") == F.col("r")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"b{k}"))
    inside = F.sum("m").over(Window.partitionBy("range", *ks).orderBy("v"))
    return ranged.withColumn("inside", inside).join(before, same).select(*ks, "v", "m", (F.col("inside") + F.col("before")).alias("upto"), "n")


def quantiles(df: DataFrame, keys: list[str], value: Column, marks: dict[str, float]) -> DataFrame:
    """keys and a column for each mark: the continuous quantile of the group's known values, between the two neighbouring
    values where its place is no whole number. Groups without a known value are absent."""
    p = _placed(df, keys, value)
    ks = [c for c in p.columns if c.startswith("k")]
    at = lambda place: F.max(F.when((F.col("upto") - F.col("m") <= place) & (place < F.col("upto")), F.col("v")))
    places = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in marks.items()}
    pairs = [c for name, place in places.items() for c in (at(F.floor(place)).alias(f"lo_{name}"), at(F.ceil(place)).alias(f"hi_{name}"))]
    one = p.groupBy(*ks).agg(F.max("n").alias("n"), *pairs)
    between = [(F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (place - F.floor(place))).alias(name) for name, place in places.items()]
    return one.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=False)], *between)


def beside(grouped: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """A grouped result with the quantiles of the same groups, null where a group has none."""
    if not keys:
        return grouped.join(found, F.lit(True), "left")
    other = found.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`"))
    return grouped.join(other, same, "left").drop(*[f"__{k}" for k in keys])
