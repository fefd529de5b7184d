"""Intermediate tables in the folder that driver and executors share: durable, so that lost executors cost a task."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir. Where that is unset,
    an own one if all runs in one process; an error on a cluster, whose machines would each write to their own disk."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lakelens-")
    return _own_dir


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's intermediate tables."""
    return f"{shared_dir(spark)}/lakelens/{spark.sparkContext.applicationId}"


_released_at_exit: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    own = own_dir(spark)
    if own not in _released_at_exit:
        _released_at_exit.add(own)
        atexit.register(_release_quietly, spark, own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. Results not written elsewhere read them until then; they go at
    the end of the application if it hasn't been stopped before."""
    drop_path(spark, own_dir(spark))


def _release_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        drop_path(spark, path)


@contextlib.contextmanager
def set_conf(spark: SparkSession, **settings: str):
    """Holds settings of the session within a block; dots are written as two underscores."""
    before = {}
    for k, v in settings.items():
        key = k.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, v)
    try:
        yield
    finally:
        for key, v in before.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def released_shuffles(spark: SparkSession):
    """Within this block, a finished execution frees its shuffle files at once: its result is already a written table."""
    return set_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def exact_unions(spark: SparkSession) -> None:
    """Turns off that a union keeps its inputs' partitioning: in Spark 4.1 adaptive execution may merge the partitions of
    two inputs in different ways, and an aggregation after the union then finds a key in two places (a fused ranking
    counted some documents twice). The session stays so."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    exact_unions(spark)
    path = path or new_path(spark, tag)
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table of this run that nothing reads any more."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
