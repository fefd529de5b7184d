"""The facade: one corpus of documents, its lexical and dense indexes, and questions answered by route."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import token_estimate
from .operators import guard, lexicon, retrieval, scoped
from .storage import new_path


@dataclass
class Answer:
    question: str
    mode: str
    rows: list = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    sql: str | None = None
    note: str = ""
    error: str | None = None
    whole: str | None = None


class Engine:
    """docs: id, text, and whatever columns filters use, registered as view `corpus`.

    embed: column of texts -> column of vectors. rerank: (query, text) -> score. write_sql: (question, error) -> reply.
    narrow: (constraints, hint) -> statement that selects ids. facts: question -> (needs_text, constraints).
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, embed: Callable[[Column], Column] | None = None, rerank: Callable[[Column, Column], Column] = retrieval.word_overlap, write_sql=None, narrow=None, facts=None, guarded: dict[str, str] | None = None, stemmed: bool = True):
        self.spark, self.docs, self.embed, self.score = spark, docs, embed, rerank
        self.write_sql, self.narrow, self.facts, self.guarded, self.stemmed = write_sql, narrow, facts, guarded or {}, stemmed
        docs.createOrReplaceTempView("corpus")
        self.index = lexicon.create(docs, "id", F.col("text"), new_path(spark, "lexicon"), stemmed)
        self.vectors = docs.select(F.col("id").alias("vec_id"), embed(F.col("text")).alias("embedding")).where("embedding is not null").persist() if embed else None

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "query_id bigint, query string")

    def ranking(self, text: str, k: int = 10, retriever: str = "hybrid_rerank", ids: DataFrame | None = None) -> DataFrame:
        """query_id, id, rank by a named retriever, within ids (id) if given."""
        if retriever not in retrieval.RETRIEVERS:
            raise ValueError(f"unknown retriever {retriever}: {', '.join(retrieval.RETRIEVERS)}")
        q, deep = self._query(text), max(100, k)
        within = lambda name: None if ids is None else ids.select(F.col("id").alias(name))
        lexical = lexicon.search(self.index, q, deep, within("doc_id")).ranking.select("query_id", F.col("doc_id").alias("id"), "rank")
        if retriever == "lexical" or self.vectors is None:
            return lexical.where(F.col("rank") <= k)
        vectors = q.select("query_id", self.embed(F.col("query")).alias("query"))
        dense = retrieval.dense(self.vectors, vectors, deep, within("vec_id")).select("query_id", F.col("vec_id").alias("id"), "rank")
        if retriever == "dense":
            return dense.where(F.col("rank") <= k)
        fused = retrieval.hybrid(lexical, dense, max(50, k))
        if retriever == "hybrid":
            return fused.where(F.col("rank") <= k).select("query_id", "id", "rank")
        wide = fused.join(self.docs.select("id", "text"), "id").join(F.broadcast(q), "query_id")
        return retrieval.rerank(wide, self.score, k).select("query_id", "id", "rank")

    def search(self, text: str, k: int = 10, retriever: str = "hybrid_rerank", ids: DataFrame | None = None) -> list:
        found = self.ranking(text, k, retriever, ids)
        return [tuple(r) for r in self.docs.join(found, "id").orderBy("rank").select("rank", "id", "text").collect()]

    def context(self, text: str, k: int = 10, budget: int = 7280) -> DataFrame:
        """Texts of the best documents within a budget of tokens."""
        found = self.docs.join(self.ranking(text, k), "id").withColumn("tokens", token_estimate(F.col("text")))
        return retrieval.budget_prefix(found, ["query_id"], [F.col("rank")], "tokens", budget)

    def ask_sql(self, question: str) -> guard.Result:
        return guard.ask(self.spark, question, self.write_sql)

    def ask(self, question: str, k: int = 10, mode: str | None = None) -> Answer:
        """Answers by the route that the question's facts call for."""
        needs, constraints = self.facts(question) if self.facts else (None, None)
        mode = mode or guard.route(needs, constraints)
        if mode == "sql":
            out = self.ask_sql(question)
            return Answer(question, mode, out.rows, out.columns, out.sql, f"not recorded: {out.no_such_data}" if out.no_such_data else "", out.error, out.whole)
        if mode == "vector" or self.narrow is None:
            return Answer(question, "vector", self.search(question, k), ["rank", "id", "text"])
        held = scoped.retrieve(self.spark, constraints or [question], self.narrow, lambda ids: self.ranking(question, k, ids=ids), self.guarded)
        rows = [] if held.results is None else [tuple(r) for r in self.docs.join(held.results, "id").orderBy("rank").select("rank", "id", "text").collect()]
        return Answer(question, mode, rows, ["rank", "id", "text"], held.sql, held.note)
