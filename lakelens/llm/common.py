"""What the operators share: durable intermediate tables and small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import time

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import drop_path, new_path, release, set_conf, shared_dir

__all__ = ["drop_path", "materialize", "new_path", "read", "release", "released_shuffles", "set_conf", "shared_dir", "shuffle_partitions", "text_of", "trimmed"]

#: Characters that the contracts call white space: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Spark's own bound of an Arrow batch.
_DEFAULT_BYTES = "67108864b"


def released_shuffles(spark: SparkSession):
    small_batches(spark)
    return storage.released_shuffles(spark)


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """A written table of df, for long texts: see storage.materialize. The driver hands freed memory back as well."""
    small_batches(df.sparkSession)
    try:
        return storage.materialize(df, tag, path)
    finally:
        _trim(ctypes, pa)
        _collect(df.sparkSession)


#: Seconds between collections of the driver's heap, and when the last one was.
COLLECT_S, _collected = 5.0, [0.0]


def _collect(spark: SparkSession) -> None:
    """A full collection of the driver's heap now and then: plans and counters of finished jobs go, and what they took goes
    back to the system, of the heap and of what native code had allocated and freed. Otherwise
    the heap would stay at up to 3.3 times what lives in it, and freed native memory would add up from job to job."""
    if time.monotonic() - _collected[0] > COLLECT_S:
        with _least_free_heap(spark):
            spark._jvm.System.gc()
        _trim_jvm(spark)
        _collected[0] = time.monotonic()


@contextlib.contextmanager
def _least_free_heap(spark: SparkSession):
    """Collections within this block leave as little of the heap free as the JVM's own lower bound allows; the application's
    setting holds again after it. JVMs without these settings collect as they do."""
    bean = was = None
    with contextlib.suppress(Py4JError):
        kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        bean = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        least, was = (bean.getVMOption(f"{x}HeapFreeRatio").getValue() for x in ("Min", "Max"))
        bean.setVMOption("MaxHeapFreeRatio", least)
    try:
        yield
    finally:
        if was is not None:
            bean.setVMOption("MaxHeapFreeRatio", was)


def _trim_jvm(spark: SparkSession) -> bool:
    """What _trim does, in the driver's JVM: by its management command, false where it has none."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, args)
        return True
    return False


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2000 rows and 8 MB from now on, where the session has Spark's defaults: texts are long."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT_BYTES, "8m")):
        if spark.conf.get(key, None) in (None, default):
            spark.conf.set(key, ours)


def trimmed(run, encodes: bool = False):
    """A function over Arrow batches that hands freed memory back to the system now and then: workers live on from task
    to task, and what they keep adds up beside the executor's heap. Pieces that a tokenizer's cache holds go as well, but
    for steps of an operator that encodes."""

    def go(batches):
        import sys
        import time

        last, tokens = 0.0, sys.modules.get(f"{__package__}.tokens")
        if tokens is not None and not encodes:
            tokens.forget()
        for out in run(batches):
            yield out
            if time.monotonic() - last > 1:
                _trim(ctypes, pa)
                last = time.monotonic()
        _trim(ctypes, pa)

    return go


def _trim(ctypes, pa) -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has this
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    storage.exact_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
