"""Embedding of texts in batches that can stop and go on: what is stored is known by the texts' fingerprints.

A store is a folder of batches, each written and committed as a whole by Spark. A run takes the fingerprints that no
committed batch has, deals them into batches of bounded size by their own value, and embeds one batch after the other; a
run that is killed leaves its finished batches, and the next run embeds only the rest. Equal texts are embedded once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..sources.readers import write_text
from ..storage import drop_path, file_system, materialize, new_path

SCHEMA = "fingerprint string, embedding array<double>"


def text_fingerprint(text: Column) -> Column:
    """All of a text's SHA-256: a store tells texts apart by it alone."""
    return F.sha2(or_empty(text).cast("binary"), 256)


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of finished batches."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [f"{path}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("batch-")]
    return sorted(n for n in names if fs.exists(file_system(spark, f"{n}/_SUCCESS")[1]))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, embedding of all finished batches; the embedding is null for texts that give none."""
    folders = committed(spark, path)
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def _checked(spark: SparkSession, path: str, model: str) -> None:
    fs, p = file_system(spark, f"{path}/model.json")
    if not fs.exists(p):
        write_text(spark, f"{path}/model.json", json.dumps({"model": model}))
    elif (held := json.loads(spark.read.text(f"{path}/model.json", wholetext=True).head()["value"]))["model"] != model:
        raise ValueError(f"the store is of {held['model']}, not of {model}")


def embed_missing(chunks: DataFrame, path: str, embed: Callable[[Column], Column], model: str, batch_rows: int = 50_000, most_batches: int | None = None) -> int:
    """Embeds the texts of (text) that a store lacks and tells how many batches it wrote; most_batches stops early."""
    spark = chunks.sparkSession
    _checked(spark, path, model)
    texts = chunks.select(text_fingerprint(F.col("text")).alias("fingerprint"), or_empty(F.col("text")).alias("text"))
    left_path = new_path(spark, "to-embed")
    left = materialize(texts.join(stored(spark, path).select("fingerprint"), "fingerprint", "left_anti").dropDuplicates(["fingerprint"]), "", left_path)
    n = left.count()
    batches = -(-n // batch_rows)
    # A batch is a range of hashes, so that it can be read by itself; they are of like size.
    number = F.pmod(F.xxhash64("fingerprint"), F.lit(max(batches, 1)))
    done = 0
    for i in range(batches if most_batches is None else min(batches, most_batches)):
        rows = left.where(number == i).select("fingerprint", embed(F.col("text")).cast("array<double>").alias("embedding"))
        rows.write.parquet(f"{path}/batch-{uuid.uuid4().hex}")
        done += 1
    drop_path(spark, left_path)
    return done


def vectors(chunks: DataFrame, path: str, key: str) -> DataFrame:
    """key, embedding of chunks (key, text) from a store; an error if it lacks any of them."""
    spark = chunks.sparkSession
    asked = chunks.select(key, text_fingerprint(F.col("text")).alias("fingerprint"))
    held = stored(spark, path).dropDuplicates(["fingerprint"])  # two runs at once may both have embedded a text
    missing = asked.join(held.select("fingerprint"), "fingerprint", "left_anti")
    if not missing.isEmpty():
        raise ValueError("the store lacks texts: embed_missing() first")
    return asked.join(held, "fingerprint").select(key, "embedding")
