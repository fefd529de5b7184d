"""A bank as a table that changes all at once: additions and removals are validated and written as a new version, and a
pointer, renamed over the old one in one step, says which version is the bank."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system
from .records import violations


def _version(spark: SparkSession, path: str) -> str | None:
    fs, pointer = file_system(spark, f"{path}/CURRENT")
    if not fs.exists(pointer):
        return None
    return spark.read.text(f"{path}/CURRENT").head()["value"].strip()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The bank, or none where there is none yet."""
    version = _version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/{version}")


class Conflict(Exception):
    """Another writer has replaced the version that a change was made to."""


TRIES = 5


def _changed(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame]) -> None:
    """Replaces the bank by change(bank), made anew to what another writer left if one came first."""
    for attempt in range(TRIES):
        before = _version(spark, path)
        try:
            return swap(change(None if before is None else spark.read.parquet(f"{path}/{before}")), path, before)
        except Conflict:
            if attempt == TRIES - 1:
                raise


def swap(new: DataFrame, path: str, before: str | None = "") -> None:
    """Writes a new version beside the one before (the current one, if none is named) and moves the pointer: readers see the old version or the new one, whole,
    at any time, and a write that fails between changes nothing. Of several writers that replace one version only the
    first to claim it succeeds; a claim whose writer stopped is carried out by the next one. The version before stays for
    those that still read it, and older ones go."""
    spark = new.sparkSession
    before = _version(spark, path) if before == "" else before
    version = f"v-{uuid.uuid4().hex}"
    new.coalesce(1).write.parquet(f"{path}/{version}")
    fs, claim = file_system(spark, f"{path}/after-{before}")
    try:
        out = fs.create(claim, False)
        out.write(bytearray(version.encode()))
        out.close()
    except Py4JJavaError as e:
        claimed = spark.read.text(f"{path}/after-{before}").head()
        if claimed and _version(spark, path) == before:
            _point(spark, path, before, claimed["value"].strip())
        fs.delete(file_system(spark, f"{path}/{version}")[1], True)
        raise Conflict(path) from e
    if _version(spark, path) != before:
        raise Conflict(path)
    _point(spark, path, before, version)


def _point(spark: SparkSession, path: str, before: str | None, version: str) -> None:
    fs, fresh = file_system(spark, f"{path}/.CURRENT-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(file_system(spark, f"{path}/CURRENT")[1]), overwrite)
    for f in fs.listStatus(file_system(spark, path)[1]):
        name = f.getPath().getName()
        if name.startswith(("v-", "after-")) and name not in (before, version, f"after-{before}"):
            fs.delete(f.getPath(), True)


def promote(spark: SparkSession, bank_path: str, drafts: DataFrame) -> int:
    """Adds drafts to the bank if the whole still validates; returns how many."""

    def added(bank: DataFrame | None) -> DataFrame:
        whole = drafts if bank is None else bank.unionByName(drafts)
        broken = violations(whole).limit(20).collect()
        if broken:
            raise ValueError("; ".join(f"{r['question_id']}: {r['violation']}" for r in broken))
        return whole

    n = drafts.count()
    _changed(spark, bank_path, added)
    return n


def archive(spark: SparkSession, bank_path: str, archive_path: str, ids: list[str], reason: str) -> int:
    """Moves records to the archive, a bank of its own. The archive is written first, so a failure between leaves a record
    in both, never in none; a record that the archive has already is replaced there, so trying again doubles none."""
    bank = current(spark, bank_path)
    gone = None if bank is None else bank.where(F.col("question_id").isin(ids))
    if gone is None or (n := gone.count()) != len(set(ids)):
        raise ValueError("some ids are not in the bank")
    twins = bank.where(F.col("twin_id").isin(ids) & ~F.col("question_id").isin(ids)).select("question_id").collect()
    if twins:
        raise ValueError(f"twins stay behind: {sorted(r[0] for r in twins)}")
    moved = gone.withColumns({"reason": F.lit(reason), "archived_at": F.current_timestamp()})
    rest = lambda held: held.where(~F.col("question_id").isin(ids))
    _changed(spark, archive_path, lambda held: moved if held is None else rest(held).unionByName(moved))
    _changed(spark, bank_path, rest)
    return n
