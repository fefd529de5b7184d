"""Verification of recorded claims by running their statements again, and the checks of a record before it is accepted."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import topic_words
from . import compare, guard
from .records import GOLD_BOUNDS, LEVELS
from .similarity import LABEL_ECHO

#: Fixed value: the most rows that a claim's statement is read for.
ROW_CAP = 5000
LEAST_READ_FIRST = 2
#: Adversarial subtypes that need an answerable twin.
TWINNED = ("zero-match", "false-presupposition")


@dataclass(frozen=True)
class Check:
    owner: str
    name: str
    status: str  # PASS, FAIL, WARN or N/A; WARN never gates
    detail: str = ""


def evidence(spark: SparkSession, owner: str, sql: str, claim: str, expect_empty: bool = False) -> Check:
    """Runs one statement: it must give rows (or none, where that is the claim) and bear out the claim's numbers."""
    out = guard.run(spark, sql, ROW_CAP)
    if out.error:
        return Check(owner, "EVIDENCE", "FAIL", out.error)
    empty = compare.is_empty_result(out.rows)
    if expect_empty:
        return Check(owner, "EVIDENCE", "PASS" if empty else "FAIL", "" if empty else f"{len(out.rows)} rows where none were claimed")
    if empty:
        return Check(owner, "EVIDENCE", "FAIL", "no rows")
    lost = compare.unreproduced(claim, out.rows, sql, ROW_CAP)
    return Check(owner, "EVIDENCE", "FAIL" if lost else "PASS", f"not reproduced: {', '.join(lost)}" if lost else "")


def verify(spark: SparkSession, items: Iterable[dict]) -> DataFrame:
    """owner, name, status, detail for every recorded claim (owner, sql, claim, expect_empty). Statements come from a
    journal's few hundred entries; each runs distributed."""
    rows = [evidence(spark, i["owner"], i["sql"], i.get("claim", ""), i.get("expect_empty", False)) for i in items]
    return spark.createDataFrame([(c.owner, c.name, c.status, c.detail) for c in rows], "owner string, name string, status string, detail string")


def live_ids(spark: SparkSession, sql: str, id_column: str = "id") -> tuple[set | None, str]:
    """The ids that a filter selects now, or none and why: an error, or more rows than are read."""
    out = guard.run(spark, guard.without_limit(sql.strip().rstrip(";")), ROW_CAP)
    if out.error or out.truncated:
        return None, out.error or f"more than {ROW_CAP} rows"
    at = out.columns.index(id_column) if id_column in out.columns else 0
    return {r[at] for r in out.rows}, ""


def compared(owner: str, live: set | None, why: str, recorded: list[int]) -> Check:
    if live is None:
        return Check(owner, "SURVIVORS", "FAIL", why)
    gone, new = sorted(set(recorded) - live), sorted(live - set(recorded))
    return Check(owner, "SURVIVORS", "FAIL" if gone or new else "PASS", f"gone {gone[:5]}, new {new[:5]}" if gone or new else "")


def survivors(spark: SparkSession, owner: str, sql: str, recorded: list[int], id_column: str = "id") -> Check:
    """Whether a filter still selects exactly the recorded ids."""
    return compared(owner, *live_ids(spark, sql, id_column), recorded)


def absence(spark: SparkSession, owner: str, proofs: list[dict]) -> list[Check]:
    """Each proof (sql, expect: empty, also called zero, or rows) must hold; without any there is no absence."""
    if not proofs:
        return [Check(owner, "ABSENCE", "FAIL", "no proof")]
    out = []
    for p in proofs:
        if p.get("expect") not in ("empty", "zero", "rows") or not (p.get("sql") or "").strip():
            out.append(Check(owner, "ABSENCE", "FAIL", f"no statement, or an unknown expectation: {p.get('expect')}"))
        else:
            out.append(evidence(spark, owner, p["sql"], p.get("key_result", ""), p["expect"] != "rows"))
    return out


def unreadable(corpus: DataFrame, ids: list[int]) -> str:
    """Which of the ids the corpus (id, has_text) lacks or has no text of; empty if none."""
    found = {r["id"]: bool(r["has_text"]) for r in corpus.where(F.col("id").isin(list(set(ids)))).groupBy("id").agg(F.bool_or("has_text").alias("has_text")).collect()}
    lost, bare = sorted(set(ids) - set(found)), sorted(i for i, ok in found.items() if not ok)
    return f"unknown {lost}, without text {bare}" if lost or bare else ""


def map_entry(entries: DataFrame, corpus: DataFrame, buckets: DataFrame) -> DataFrame:
    """owner, name, status, detail of map entries (owner, bucket, about, read_first, read, used): ids exist and have text
    (corpus: id, has_text), lie in their bucket (buckets: id, bucket), enough were read before any search, what was read
    first is among what was read and not all of it among what a search found, and the prose is no echo of the label."""
    each = entries.select("owner", "bucket", F.explode("read").alias("id"))
    seen = each.join(corpus, "id", "left").join(buckets.select("id", F.col("bucket").alias("own")).distinct(), "id", "left")
    ids = seen.groupBy("owner").agg(
        F.array_sort(F.collect_set(F.when(F.col("has_text").isNull(), F.col("id")))).alias("unknown"),
        F.array_sort(F.collect_set(F.when(~F.col("has_text"), F.col("id")))).alias("textless"),
        F.array_sort(F.array_except(F.collect_set("id"), F.collect_set(F.when(F.col("own") == F.col("bucket"), F.col("id"))))).alias("outside"),
    )
    wide = entries.join(ids, "owner", "left")
    first = F.coalesce("read_first", F.expr("cast(array() as array<bigint>)"))
    about, label = topic_words(F.col("about")), topic_words(F.col("bucket"))
    share = F.size(F.array_intersect(about, label)) / F.nullif(F.size(F.array_union(about, label)), F.lit(0))
    tests = [
        ("EXIST", F.coalesce(F.size("unknown"), F.lit(0)) == 0, F.array_join(F.col("unknown").cast("array<string>"), ",")),
        ("TEXT", F.coalesce(F.size("textless"), F.lit(0)) == 0, F.array_join(F.col("textless").cast("array<string>"), ",")),
        ("BUCKET", F.coalesce(F.size("outside"), F.lit(0)) == 0, F.array_join(F.col("outside").cast("array<string>"), ",")),
        ("READ-FIRST", (F.size(first) >= LEAST_READ_FIRST) & (F.size(F.array_except(first, F.col("read"))) == 0), F.size(first).cast("string")),
        ("INDEPENDENT", F.size(F.array_except(first, F.coalesce("used", F.expr("cast(array() as array<bigint>)")))) > 0, F.lit("")),
        ("LABEL-ECHO", F.coalesce(share < LABEL_ECHO, F.lit(True)), F.round(share, 3).cast("string")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), F.coalesce(F.when(~ok, d), F.lit("")).alias("detail")) for n, ok, d in tests])
    return wide.select("owner", F.explode(rows).alias("c")).select("owner", "c.*")


def twin_checks(spark: SparkSession, owner: str, twin_id: str, bank: DataFrame, corpus: DataFrame | None) -> list[Check]:
    """The twin is another, answerable question of the bank, and its gold still holds: its statement gives rows, or the
    projects of its gold have text."""
    failed = lambda why: [Check(owner, "TWIN-EXISTS", "FAIL", why)]
    if twin_id == owner:
        return failed("its own twin")
    row = bank.where(F.col("question_id") == twin_id).head()
    if row is None:
        return failed(f"{twin_id} is not in the bank")
    twin = row.asDict(recursive=True)
    if "adversarial" == twin.get("expected_route") or twin.get("level") == "ADV":
        return failed(f"{twin_id} is adversarial")
    out = [Check(owner, "TWIN-EXISTS", "PASS", twin_id)]
    if (twin.get("gold_sql") or "").strip():
        ran = guard.run(spark, twin["gold_sql"], ROW_CAP)
        why = ran.error or ("" if ran.rows else "its statement gives no rows")
    elif twin.get("gold_project_ids"):
        if corpus is None:
            return [*out, Check(owner, "TWIN-LIVE", "WARN", "no corpus to look its gold up in")]
        why = unreadable(corpus, twin["gold_project_ids"])
    else:
        return [*out, Check(owner, "TWIN-LIVE", "N/A", "neither statement nor gold ids")]
    return [*out, Check(owner, "TWIN-LIVE", "FAIL" if why else "PASS", why)]


def precheck(spark: SparkSession, record: dict, bank: DataFrame | None = None, corpus: DataFrame | None = None, schema_hash: str | None = None) -> list[Check]:
    """The checks of one drafted record by running its statements again. Checks that don't concern the record are left
    out, as are those for which bank, corpus (id, has_text) or the live schema document's hash isn't given.

    GOLD-SQL, ANSWER-COLUMNS, GOLD-TEXT, SURVIVORS, GOLD-SURVIVES and WINDOW (of the live survivors), LEVEL (the bound of
    gold ids: of the subtype for hybrid records, else of the level), GOLD-EMPTY, absence, TWIN-EXISTS, TWIN-LIVE,
    SCHEMA-DOCS.
    """
    owner, route, subtype, out = record["question_id"], record.get("expected_route"), record.get("subtype"), []
    add = lambda name, why, bad="FAIL": out.append(Check(owner, name, bad if why else "PASS", why))
    ladder, adversarial = record.get("level") in LEVELS, route == "adversarial" or record.get("level") == "ADV"
    gold = record.get("gold_project_ids") or []
    if (record.get("gold_sql") or "").strip():
        ran = guard.run(spark, record["gold_sql"], ROW_CAP)
        add("GOLD-SQL", ran.error or ("" if ran.rows else "no rows"))
        if record.get("answer_columns") and not ran.error and ran.rows:
            have = {c.lower() for c in ran.columns}
            lost = [c for c in record["answer_columns"] if str(c).lower() not in have]
            add("ANSWER-COLUMNS", f"not in the result: {lost}" if lost else "")
    elif route == "sql" and ladder:
        add("GOLD-SQL", "no statement")
    if gold and corpus is not None:
        add("GOLD-TEXT", unreadable(corpus, gold))
    filtered = record.get("filter_evidence") or {}
    if (filtered.get("filter_sql") or "").strip():
        live, why = live_ids(spark, filtered["filter_sql"])
        if live is not None and len(live) > compare.SURVIVOR_CEILING:
            live, why = None, f"more than {compare.SURVIVOR_CEILING} survivors"
        out.append(compared(owner, live, why, filtered.get("survivor_ids") or []))
        if live is not None:
            stray = sorted(set(gold) - live)
            add("GOLD-SURVIVES", str(stray) if stray else "")
            low, high = compare.WINDOWS.get(subtype, (1, compare.SURVIVOR_CEILING))
            add("WINDOW", "" if low <= len(live) <= high else f"{len(live)} live survivors", "WARN")
    elif filtered or (route == "hybrid" and ladder):
        add("SURVIVORS", "no filter")
    if route in ("vector", "hybrid") and gold:
        n = len(set(gold))
        if route == "hybrid" and subtype in GOLD_BOUNDS:
            low, high = GOLD_BOUNDS[subtype]
            add("LEVEL", "" if low <= n and (high is None or n <= high) else f"{n} gold ids, {subtype} has {low} to {high or 'any'}")
        else:
            level = "L1" if n == 1 else "L2" if n <= 4 else "L3"
            add("LEVEL", "" if record.get("level") == level else level)
    if adversarial:
        if subtype == "zero-match":
            add("GOLD-EMPTY", "" if record.get("gold_project_ids") == [] else f"gold ids {record.get('gold_project_ids')}")
        out += absence(spark, owner, record.get("absence_evidence") or [])
    if record.get("twin_id"):
        if bank is not None:
            out += twin_checks(spark, owner, record["twin_id"], bank, corpus)
    elif adversarial and subtype in TWINNED:
        add("TWIN-EXISTS", "no twin")
    if schema_hash is not None:
        held = [h for h in (record.get("schema_docs_hash"), filtered.get("schema_docs_hash")) if h]
        stale = [h for h in held if h != schema_hash]
        if held or (route in ("sql", "hybrid") and ladder):
            add("SCHEMA-DOCS", f"recorded {stale}, live {schema_hash}" if stale else "" if held else "no hash")
    return out
