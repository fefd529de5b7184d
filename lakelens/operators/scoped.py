"""Filtered search: a statement selects ids, a search runs within them, and an empty filter is believed only with proof."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import guard

# Fixed value: from so many ids on a filter hardly narrows.
WEAK_FROM = 5000


@dataclass
class Scoped:
    """status: ok, zero_match, sql_failed, value_not_found, unproven_zero."""

    status: str
    results: DataFrame | None
    sql: str | None = None
    n_ids: int | None = None
    weak: bool = False
    truncated: bool = False
    dead: list = field(default_factory=list)
    note: str = ""


def note(status: str, n: int | None, weak: bool) -> str:
    if status == "zero_match":
        return "No record meets all conditions; each of them alone is met."
    if status in ("sql_failed", "unproven_zero", "value_not_found"):
        return "The filter could not be applied; results are of the whole corpus."
    return f"Results are within the complete set of {n} records" + (", which hardly narrows the search." if weak else ".")


def retrieve(
    spark: SparkSession,
    constraints: list[str] | None,
    write_sql: Callable[[list[str], str | None], str],
    search: Callable[[DataFrame | None], DataFrame],
    tables: dict[str, str],
    id_column: str = "id",
    banned: list[str] = (),
    limit: int | None = None,
) -> Scoped:
    """Runs the machine in its fixed order: no constraints, narrowing, re-asking for banned or constant conditions,
    failure, value gate with one re-asking, ids, zero proof, flags, search.

    tables: guarded column -> view that holds its values. search(ids or None) -> ranking, always within all ids: a LIMIT
    of the writer's is dropped. limit: the most ids that the caller shows; truncated tells that there are more.
    """
    checked = lambda hint: guard.without_limit(guard.validate(guard.without_fences(write_sql(constraints, hint))))
    if not constraints:
        return Scoped("ok", search(None), note="No constraints; results are of the whole corpus.")
    sql, hint = None, None
    for _ in range(2):
        try:
            sql = checked(hint)
        except guard.GuardError as e:
            sql, hint = None, str(e)
            continue
        problems = guard.lint(sql, list(banned))
        if not problems:
            break
        sql, hint = None, "; ".join(problems)
    failed = lambda status, dead=(): Scoped(status, search(None), sql, dead=list(dead), note=note(status, None, False))
    if sql is None:
        return failed("sql_failed")
    dead = dead_values(spark, sql, tables)
    if dead:
        try:
            again = checked(f"no such values: {dead}")
        except guard.GuardError:
            return failed("value_not_found", dead)
        if guard.lint(again, list(banned)) or dead_values(spark, again, tables):
            return failed("value_not_found", dead)
        sql = again
    try:
        ids = spark.sql(sql).select(F.col(id_column)).distinct()
        n = ids.count()
    except PySparkException:  # the statement's own fault, or its data's
        return failed("sql_failed")
    if n == 0:
        verdict, _ = guard.zero_proof(spark, guard.validate(sql))
        if verdict == "unproven":
            return failed("unproven_zero")
        return Scoped("zero_match", None, sql, 0, note=note("zero_match", 0, False))
    truncated, weak = limit is not None and n > limit, n > WEAK_FROM
    return Scoped("ok", search(ids), sql, n, weak, truncated, note=note("ok", n, weak))


def dead_values(spark: SparkSession, sql: str, tables: dict[str, str]) -> list[tuple[str, str, str]]:
    wanted = guard.literals(sql, list(tables))
    counts = []
    for view in sorted(set(tables.values())):
        own = [x for x in wanted if tables[x.column] == view]
        if own:
            counts += [tuple(r) for r in guard.live_values(spark.table(view), own).collect()]
    return guard.dead_literals(counts)


def strip_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """answer_id, text without the citations of ids that retrieved (answer_id, ids) doesn't hold, and a log of those."""
    from ..functions.text import CITATION

    both = answers.join(retrieved, "answer_id", "left")
    held = F.coalesce("ids", F.expr("cast(array() as array<bigint>)"))
    cited = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CITATION), 0)
    alien = F.array_distinct(F.filter(cited, lambda c: ~F.array_contains(held, F.regexp_extract(c, CITATION, 1).cast("bigint"))))
    clean = F.aggregate("removed", F.coalesce("text", F.lit("")), lambda text, c: F.replace(text, c, F.lit("")))
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r" +([.,;:])", "$1"), " {2,}", " "))
    return both.withColumn("removed", alien).select("answer_id", F.when(F.size("removed") > 0, clean).otherwise(F.col("text")).alias("text"), "removed")


def cited_outside(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers (answer_id, text) with the ids that they cite but retrieved (answer_id, ids) doesn't hold."""
    from ..functions.text import cited_ids

    both = answers.join(retrieved, "answer_id", "left")
    outside = F.array_sort(F.array_except(cited_ids(F.col("text")), F.coalesce("ids", F.expr("cast(array() as array<bigint>)"))))
    return both.select("answer_id", outside.alias("outside"))
