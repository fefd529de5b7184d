"""Runs of a question bank: each question under each condition once, journaled as it is done, resumed where it stopped,
and summed up in a report."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from ..storage import file_system
from . import compare, guard, records, retrieval

RECORD = (
    "run_id string, condition string, question_id string, expected_route string, level string, mode string, status string, passed boolean, reason string, "
    "n_rows bigint, hit int, recall double, mrr double, ndcg double, seconds double, started bigint"
)
#: Conditions that take another way than the router's.
FORCED = {"router": None, "force-sql": "sql", "force-vector": "vector", "always-scoped": "scoped"}


def journal(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each condition and question, in the order in which they were first written."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], RECORD + ", first_seen bigint")
    rows = spark.read.schema(RECORD).json(path)
    return records.collapse(rows, ["condition", "question_id"], "started").select(*[c.split()[0] for c in RECORD.split(", ")], "first_seen")


def one_question(engine, question: dict, condition: str, k: int) -> dict:
    """What a question gives under a condition: executed or error, and its score: of sql questions the rows against those
    of the gold statement, run again; of others the ranking against the gold ids."""
    out = {"mode": None, "status": "executed", "passed": None, "reason": "", "n_rows": 0, "hit": None, "recall": None, "mrr": None, "ndcg": None}
    spark = engine.spark
    try:
        answer = engine.ask(question["text"], k, FORCED[condition])
    except Exception as e:  # a question's failure is a record of the run, not its end
        return out | {"status": "error", "reason": f"{type(e).__name__}: {str(e).splitlines()[0]}"}
    out |= {"mode": answer.mode, "n_rows": len(answer.rows)}
    if question.get("gold_sql"):
        try:
            gold = spark.sql(guard.validate(question["gold_sql"]))
        except Exception as e:
            return out | {"reason": f"gold failed: {type(e).__name__}: {str(e).splitlines()[0]}"}
        # Both statements are scored whole: the limit of an answer bounds only what is shown.
        got = None if answer.mode != "sql" or answer.error or answer.sql is None else spark.sql(guard.validate(answer.whole or answer.sql))
        try:
            passed, reason = compare.score(gold, got, question.get("answer_columns"))
        except Exception as e:
            return out | {"reason": f"scoring failed: {type(e).__name__}: {str(e).splitlines()[0]}"}
        if got is None and answer.mode == "sql":
            reason = "sql_failed"
        return out | {"passed": passed, "reason": reason}
    if question.get("gold_project_ids") and "id" in answer.columns:
        at, rank = answer.columns.index("id"), answer.columns.index("rank")
        ranking = spark.createDataFrame([(0, r[at], r[rank]) for r in answer.rows], "query_id bigint, id bigint, rank int")
        gold = spark.createDataFrame([(0, i) for i in question["gold_project_ids"]], "query_id bigint, id bigint")
        m = retrieval.ranking_metrics(ranking, gold, [k]).head()
        return out | {"passed": bool(m["hit"]), "reason": "" if m["hit"] else "no gold found", "hit": m["hit"], "recall": m["recall"], "mrr": m["mrr"], "ndcg": m["ndcg"]}
    return out | {"reason": "nothing to score by"}


def run_bank(engine, bank: DataFrame, path: str, run_id: str, conditions: Iterable[str] = ("router",), k: int = 10, tell: Callable[[dict], None] = lambda record: None) -> DataFrame:
    """Runs what the journal at a path lacks, or has as an error, and gives the journal. bank: question_id, text,
    expected_route, level, gold_sql, answer_columns, gold_project_ids; a few hundred questions, asked one by one. Each
    record is written as soon as it is there, under a name of its own, so a run that stops goes on with the next one."""
    conditions = list(conditions)
    if unknown := set(conditions) - set(FORCED):
        raise ValueError(f"unknown conditions: {sorted(unknown)}")
    spark, wanted = engine.spark, ["question_id", "text", "expected_route", "level", "gold_sql", "answer_columns", "gold_project_ids"]
    planned = bank.select(*wanted).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    left = records.pending(planned, journal(spark, path).where("status = 'executed'"), ["condition", "question_id"])
    for r in left.orderBy("condition", "question_id").collect():
        began = time.time()
        record = {"run_id": run_id, "condition": r["condition"], "question_id": r["question_id"], "expected_route": r["expected_route"], "level": r["level"]}
        record |= one_question(engine, r.asDict(recursive=True), r["condition"], k)
        record |= {"seconds": round(time.time() - began, 3), "started": time.time_ns()}
        row = tuple(record[c.split()[0]] for c in RECORD.split(", "))
        readers.append_journal(spark.createDataFrame([row], RECORD).coalesce(1), path, f"{run_id}-{r['condition']}-{r['question_id']}")
        tell(record)
    return journal(spark, path)


def pass_table(records_: DataFrame, *keys: str) -> DataFrame:
    """keys, passed, scored, unscored."""
    return records_.groupBy(*keys).agg(F.count_if(F.col("passed")).alias("passed"), F.count("passed").alias("scored"), F.count_if(F.col("passed").isNull()).alias("unscored"))


def routing_table(records_: DataFrame) -> DataFrame:
    """condition, expected_route, mode, n: which way each question went."""
    return records_.where("mode is not null").groupBy("condition", "expected_route", "mode").agg(F.count(F.lit(1)).alias("n"))


def bank_report(records_: DataFrame, title: str) -> str:
    """The run as Markdown: passes by condition, route and level, routing, reasons of failures, ranking metrics, times."""
    scored = records_.where("hit is not null")
    metrics = scored.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("hit", "recall", "mrr", "ndcg")])
    failed = records_.where("not passed or status = 'error'").groupBy("condition", "reason").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("question_id")), ", ").alias("questions"))
    return readers.report(
        [
            ("Passed", pass_table(records_, "condition").orderBy("condition")),
            ("By route and level", pass_table(records_, "condition", "expected_route", "level").orderBy("condition", "expected_route", "level")),
            ("Routing", routing_table(records_).orderBy("condition", "expected_route", "mode")),
            ("Ranking", metrics.orderBy("condition")),
            ("Not passed", failed.orderBy("condition", "reason")),
            ("Seconds", records_.groupBy("condition").agg(*records.cell(F.col("seconds"))).orderBy("condition")),
        ],
        title,
    )


def run_retrieval(rankings: dict[str, DataFrame], gold: DataFrame, ks: Iterable[int] = (10, 20)) -> DataFrame:
    """condition, query_id, k, hit, recall, mrr, ndcg of each named ranking (query_id, id, rank), for queries with gold."""
    out = None
    for name, r in rankings.items():
        m = retrieval.ranking_metrics(r, gold, list(ks)).select(F.lit(name).alias("condition"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def retrieval_report(metrics: DataFrame, title: str) -> str:
    """Means of each condition and cutoff, and for each pair of conditions at each cutoff how many queries either wins."""
    names = ["hit", "recall", "mrr", "ndcg"]
    means = metrics.groupBy("condition", "k").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in names])
    a, b = metrics.select(F.col("condition").alias("one"), "query_id", "k", F.col("ndcg").alias("x")), metrics.select(F.col("condition").alias("other"), "query_id", "k", F.col("ndcg").alias("y"))
    duel = a.join(b, ["query_id", "k"]).where("one < other").groupBy("one", "other", "k").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"))
    return readers.report([("Means", means.orderBy("k", "condition")), ("Wins by nDCG", duel.orderBy("k", "one", "other"))], title)
