"""Command line: python -m lakelens.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import entity_contexts, html_entities, token_estimate
from .operators import bankfile, chunking, guard, lexicon, quality, records, retrieval, runs, similarity, verify
from .plans import catalog
from .session import session, ship
from .sources import readers


def show(df, n: int = 50) -> None:
    df.show(n, truncate=60)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakelens")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=options.pop("help"))
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", type=type(v) if v is not None else str, default=v)
        return c

    add("queries", help="names of the catalogue")
    add("query", "name", "folder", limit=50, help="runs a query of the catalogue over a folder of tables")
    add("search", "docs", "text", k=10, retriever="lexical", help="searches a Parquet table of id and text")
    add("sql", "folder", "statement", limit=guard.ROW_LIMIT, help="runs a guarded statement over the tables of a folder")
    add("profile", "table", help="nulls of each column")
    add("frontier", "table", key="id", path="path", help="buckets of a table of key and path")
    add("html-entities", "table", column="html", help="HTML entities left in a column")
    add("validate-bank", "bank", help="broken rules of a JSON-lines bank")
    add("promote", "drafts", "bank", help="adds drafts to a bank if the whole validates")
    add("archive", "bank", "archive", "ids", reason="", help="moves records, ids parted by commas, to an archive")
    add("build-index", "docs", "index", stemmed="yes", help="stores the lexical index of a Parquet table of id and text")
    add("index-fresh", "docs", "index", stemmed="yes", help="whether a stored index fits a table")
    add("search-index", "index", "text", k=10, stemmed="yes", help="searches a stored index")
    add("bench-retrievers", "docs", "questions", "gold", k=10, help="metrics of the lexical ranking for Parquet tables of query_id and query, and of query_id and id")
    add("catalog", "folder", help="columns of the tables of a folder")
    add("chunk", "sections", "chunks", help="cuts a Parquet table of project_id, header, source, section and text into chunks")
    add("chunk-stats", "docs", size=1600, help="how many paragraphs of a table of id and text a cut every so many characters parts")
    add("stage-csv", "source", "staged", help="a defective delimited file as RFC 4180 files")
    add("bad-lines", "path", schema="question_id string", help="lines of JSON-lines files that are no JSON")
    add("gap-report", "bank", "staged", "plan", help="what is missing of the allocation table of a plan document; bank and staged are JSON lines")
    add("next-ids", "bank", wanted=3, help="the next free question ids of each prefix")
    add("pick", "bank", n=5, keys="expected_route,level", help="questions of the least used routes and levels")
    add("near-duplicates", "bank", help="pairs of questions that say nearly the same, twins exempt")
    add("collisions", "drafts", "bank", help="gold ids and twins that drafts share with each other or the bank")
    add("journal-stats", "journal", help="statistics of a journal of slots")
    add("run-report", "journal", title="Run", help="the report of a bank's run")
    add("latest", "journal", help="the latest record of each condition and question of a run")
    add("verify", "folder", "claims", help="runs recorded claims (JSON lines of owner, sql, claim) again")
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(catalog.queries()))
        return 0
    spark = session()
    ship(spark)

    def views(folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            name = f.getPath().getName()
            if name.endswith(".parquet"):
                spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name.removesuffix(".parquet"))

    if a.command == "query":
        show(catalog.queries()[a.name](spark, a.folder), a.limit)
    elif a.command == "search":
        for r in Engine(spark, spark.read.parquet(a.docs)).search(a.text, a.k, a.retriever):
            print(r[0], r[1], r[2][:200].replace("\n", " "))
    elif a.command == "sql":
        views(a.folder)
        out = guard.run(spark, a.statement, a.limit)
        print(out.error or "\n".join(json.dumps(dict(zip(out.columns, r, strict=True)), default=str) for r in out.rows))
        return int(out.error is not None)
    elif a.command == "profile":
        show(quality.null_profile(spark.read.parquet(a.table)))
    elif a.command == "frontier":
        t = spark.read.parquet(a.table).select(F.col(a.key).alias("id"), F.col(a.path).alias("path"))
        show(records.frontier(t.select("id").distinct(), t.where("path is not null"), "id").orderBy(F.col("n").desc(), "bucket"))
    elif a.command == "html-entities":
        e = spark.read.parquet(a.table).select(F.explode(html_entities(F.col(a.column))).alias("entity"))
        show(e.groupBy("entity").count().orderBy(F.col("count").desc(), "entity"))
    elif a.command == "validate-bank":
        from .plans.textual import _RECORD

        found = records.violations(spark.read.schema(_RECORD).json(a.bank)).cache()
        show(found)
        return int(not found.isEmpty())
    elif a.command == "promote":
        from .plans.textual import _RECORD

        print(bankfile.promote(spark, a.bank, spark.read.schema(_RECORD).json(a.drafts)))
    elif a.command == "archive":
        print(bankfile.archive(spark, a.bank, a.archive, a.ids.split(","), a.reason))
    elif a.command in ("build-index", "index-fresh"):
        docs, stemmed = spark.read.parquet(a.docs), a.stemmed == "yes"
        held = lexicon.open_lexicon(spark, a.index, stemmed)
        if a.command == "index-fresh":
            fresh = held is not None and lexicon.fresh(held, docs, "id", F.col("text"))
            print("fresh" if fresh else "stale or missing")
            return int(not fresh)
        held = lexicon.sync(held, docs, "id", F.col("text")) if held else lexicon.create(docs, "id", F.col("text"), a.index, stemmed)
        print(json.dumps(held.meta))
    elif a.command == "search-index":
        index = lexicon.open_lexicon(spark, a.index)
        q = spark.createDataFrame([(0, a.text)], "query_id bigint, query string")
        show(lexicon.search(index, q, a.k, stemmed=a.stemmed == "yes").ranking.orderBy("rank").drop("query_id"), a.k)
    elif a.command == "bench-retrievers":
        terms, lengths = retrieval.postings(spark.read.parquet(a.docs), "id", F.col("text"), True)
        found = retrieval.bm25(terms, lengths, spark.read.parquet(a.questions), a.k, stemmed=True).withColumnRenamed("doc_id", "id")
        print(runs.retrieval_report(runs.run_retrieval({"lexical": found}, spark.read.parquet(a.gold), (a.k,)), "Retrievers"))
    elif a.command == "catalog":
        views(a.folder)
        show(readers.catalog(spark).orderBy("table", "position"), 1000)
    elif a.command == "chunk":
        chunking.chunk_table(spark.read.parquet(a.sections)).write.parquet(a.chunks)
        show(spark.read.parquet(a.chunks).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n_tokens"), 1).alias("tokens")))
    elif a.command == "chunk-stats":
        s = spark.read.parquet(a.docs).select(chunking.split_paragraphs(F.col("text"), a.size).alias("x"), token_estimate(F.col("text")).alias("t"))
        show(s.agg(F.sum("x.n").alias("paragraphs"), F.sum("x.split").alias("parted"), F.sum("t").alias("tokens")))
    elif a.command == "stage-csv":
        good, bad = readers.read_delimited(spark, a.source)
        readers.write_delimited(good, a.staged)
        show(bad)
        return int(not bad.isEmpty())
    elif a.command == "bad-lines":
        found = readers.bad_lines(spark, a.path, a.schema)
        show(found)
        return int(not found.isEmpty())
    elif a.command == "gap-report":
        line = "question_id string, expected_route string, level string"
        bank, staged = (spark.read.schema(line).json(x) for x in (a.bank, a.staged))
        plan = spark.read.text(a.plan, wholetext=True).select(F.explode(readers.allocation(F.col("value"))).alias("x")).select(F.col("x.route").alias("expected_route"), "x.level", "x.target")
        show(records.gaps(bank, staged, plan, ["expected_route", "level"]).orderBy("expected_route", "level"))
    elif a.command == "next-ids":
        ids = spark.read.schema("question_id string").json(a.bank).where(F.col("question_id").rlike("^.*-[0-9]+$"))
        show(records.next_ids(ids, F.regexp_extract("question_id", "^(.*)-[0-9]+$", 1), F.regexp_extract("question_id", "([0-9]+)$", 1).cast("int"), a.wanted).orderBy("prefix", "id"))
    elif a.command == "pick":
        keys = a.keys.split(",")
        rows = [r.asDict() for r in spark.read.json(a.bank).select(F.col("question_id").alias("id"), *keys).collect()]  # a bank's few hundred
        print("\n".join(r["id"] for r in records.balanced_pick(rows, a.n, tuple(keys))))
    elif a.command == "near-duplicates":
        found = similarity.near_duplicates(spark.read.schema("question_id string, text string, twin_id string").json(a.bank).withColumnRenamed("question_id", "id")).where("flagged")
        show(found.orderBy("a", "b"))
        return int(not found.isEmpty())
    elif a.command == "collisions":
        line = "question_id string, gold_project_ids array<bigint>, twin_id string"
        drafts, bank = (spark.read.schema(line).json(x).withColumnsRenamed({"question_id": "id", "gold_project_ids": "gold"}) for x in (a.drafts, a.bank))
        show(similarity.gold_overlap(drafts, bank).orderBy("id", "other"))
        show(similarity.twin_collision(drafts.unionByName(bank)).orderBy("twin_id"))
    elif a.command == "journal-stats":
        line = "slot string, status string, candidate_index int, judge_decisions array<struct<round: string, disposition: string>>, findings array<struct<class: string, severity: string, ruling: string>>"
        show(records.journal_summary(spark.read.schema(line).json(a.journal)), 1000)
    elif a.command == "run-report":
        print(runs.bank_report(runs.journal(spark, a.journal), a.title))
    elif a.command == "latest":
        show(runs.journal(spark, a.journal).orderBy("first_seen"), 1000)
    elif a.command == "verify":
        views(a.folder)
        items = [r.asDict() for r in spark.read.schema("owner string, sql string, claim string, expect_empty boolean").json(a.claims).collect()]
        checks = verify.verify(spark, items)
        show(checks)
        return int(not checks.where("status = 'FAIL'").isEmpty())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
