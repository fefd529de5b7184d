"""Corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, and a token store at the end.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents, and whatever others the rows have, under their names. The result is the last stage's: a row for
each document of the store. Texts of any length are read whole, an empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelens.llm import decontaminate, language_id, mixing, ngram_jaccard, token_store
from lakelens.llm.common import drop_path, materialize, new_path, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language the model gives less than an even chance: null and empty
    texts go, an even chance stays, repeated rows fare alike, rows without an id stay but aren't learnt from."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word 5-grams at a Jaccard similarity of 0.8, the one of least doc_id stays; of
    several rows of that id, one. Rows of one id whose texts aren't linked all stay, rows that repeat id and text stay once,
    rows without an id come after all others, and texts without words are linked with nothing."""
    return ngram_jaccard.one_of_each(docs, size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: all rows of an id, null too, of which one holds one. Null and empty texts
    hold none; an empty benchmark drops nothing."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents so that sources weigh as the square roots of their sizes; shuffles all. A null source is
    a source, one without text gets no copies, rows that share an id get the same number."""
    return mixing.mixed_rows(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the content-addressed token store and returns what its files hold, a row for each row: null text is empty and
    gives the end id, null ids come first, rows that share an id are documents of their own."""
    # The workers have served four other stages: a smaller cache of pieces leaves room beside what those left.
    return token_store.token_store(docs, most_pieces=800_000)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_store", store_tokens),
]

#: Models, tokenizers and components of a similarity graph are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        docs = materialize(stage(spark, docs, sf_dir), "", path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
