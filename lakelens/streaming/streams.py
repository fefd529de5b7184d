"""Streaming forms: windowed counts with a watermark, and a latest-line-wins table kept by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import collapse
from ..storage import drop_path, materialize, new_path


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of tumbling windows; works on streams and on tables alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """Runs the windowed counts as a stream over a table's files until they are used up, into a Parquet sink, and reads that.
    Windows leave the state once the watermark has passed them; a last one, long after all others, closes those."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    end = new_path(spark, "stream-end")
    far = F.lit("9999-01-01").cast("timestamp")
    spark.range(1).select(far.cast("timestamp_ntz").alias("ts"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "ts"]).select(*schema.names).write.parquet(end)
    events = source.withColumn("ts", F.col("ts").cast("timestamp"))
    sink, kept = new_path(spark, "stream-sink"), new_path(spark, "stream-checkpoint")

    def go(rows: DataFrame) -> None:
        counts = windowed_counts(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", kept)
        counts.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    closing = spark.readStream.schema(schema).parquet(end).withColumn("ts", F.col("ts").cast("timestamp"))
    go(events.unionByName(closing))
    return spark.read.parquet(sink).where(F.col("start") < far).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def keep_latest(journal: DataFrame, target: str, checkpoint: str, keys: list[str], order: str):
    """Keeps a table with the last line of each key: each micro-batch merges into a new version of the table, and a
    batch that is run again writes the same version, so that every line counts once."""
    spark = journal.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("first_seen", F.col(order))
        rows = new if number == 0 else spark.read.parquet(f"{target}/v={number - 1}").unionByName(new)
        merged = collapse(rows.drop("first_seen"), keys, order).drop("first_seen")
        first = rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))
        merged.join(first, keys).write.mode("overwrite").parquet(f"{target}/v={number}")

    return journal.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest_buckets(journal: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64):
    """Keeps a table with the last line of each key and writes only what changes: rows lie in buckets by a hash of their key,
    each a partition, and a micro-batch rewrites those that it touches. first_seen is the order of a key's first line. A
    batch that is run again gives the same rows."""
    spark = journal.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    names = [*journal.columns, "first_seen", "bucket"]

    def upsert(batch: DataFrame, number: int) -> None:
        new_rows = new_path(spark, "latest-batch")
        new = materialize(batch.withColumns({"first_seen": F.col(order), "bucket": bucket}).select(*names), "", new_rows)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most all buckets
        if not touched:
            return
        rows = new
        if _is_there(spark, target):
            rows = new.unionByName(spark.read.schema(new.schema).parquet(target).where(F.col("bucket").isin(touched)).select(*names))
        first = F.min("first_seen").alias("first_seen")
        rest = [c for c in journal.columns if c not in keys]
        merged = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), order).alias("last"), first).select(*keys, "last.*", "first_seen", "bucket").select(*names)
        merged_path = new_path(spark, "latest-merged")
        held = materialize(merged, "", merged_path)
        held.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        for path in (new_rows, merged_path):
            drop_path(spark, path)

    return journal.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
