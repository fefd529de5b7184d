"""Sets of ids as bitmaps: a bit for each id, in buckets of 32,768, tested beside a scan instead of shuffling a semi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Bytes of a bucket's bitmap, as Spark's bitmap functions make them.
BUCKET_BYTES = 4096
#: Bitmaps of more bytes in all aren't broadcast.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class IdSet:
    """rows: bucket, bits, a written table; n ids in so many buckets."""

    rows: DataFrame
    n: int
    buckets: int


def gathered(ids: DataFrame, column: str) -> IdSet:
    """The distinct ids of a bigint column; nulls are no ids. Dense ids take a bit each, scattered ones up to a bucket."""
    c = F.col(column).cast("bigint")
    bits = ids.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(c).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))
    rows = materialize(bits, "id-set")
    one = rows.agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.bitmap_count("bits")).alias("n")).first()
    return IdSet(rows, one["n"] or 0, one["buckets"])


def members(df: DataFrame, column: str, ids: IdSet) -> DataFrame:
    """The rows whose id is in the set. Bitmaps proven small are broadcast, so that the rows stay where they are."""
    side = ids.rows.toDF("__bucket", "__bits")
    side = F.broadcast(side) if ids.buckets * BUCKET_BYTES <= BROADCAST_BYTES else side.hint("merge")
    c = F.col(column).cast("bigint")
    at = F.bitmap_bit_position(c)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = df.join(side, F.bitmap_bucket_number(c) == F.col("__bucket"))
    return held.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0).select(*[F.col(f"`{n}`") for n in df.columns])


def intersected(a: IdSet, b: IdSet) -> IdSet:
    """The ids in both, bucket by bucket."""
    shared = F.bitmap_and_agg("bits").alias("bits")
    both = a.rows.join(b.rows.select("bucket"), "bucket", "left_semi").unionByName(b.rows.join(a.rows.select("bucket"), "bucket", "left_semi"))
    rows = materialize(both.groupBy("bucket").agg(shared).where(F.bitmap_count("bits") > 0), "id-set")
    one = rows.agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.bitmap_count("bits")).alias("n")).first()
    return IdSet(rows, one["n"] or 0, one["buckets"])
