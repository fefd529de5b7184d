"""Comparing result sets, and checking recorded claims against live ones."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NUMBER


def canonical_row(df: DataFrame) -> Column:
    """A row as a sorted array of texts: numbers as doubles rounded to 6 places, so that neither the order of columns
    nor the kind of number matters."""

    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))

    return F.array_sort(F.array(*[value(f) for f in df.schema.fields]))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, n_a, n_b of the canonical rows that don't occur as often on both sides."""
    rows = a.select(canonical_row(a).alias("row"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(canonical_row(b).alias("row"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    return rows.groupBy("row").agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b")).where("n_a <> n_b")


def same_rows(a: DataFrame, b: DataFrame, ordered: str | None = None) -> bool:
    """Whether two results agree as multisets; ordered: name of a position column that both have, compared row by row."""
    if len(a.columns) != len(b.columns):
        return False
    if ordered:
        x = a.select(F.col(ordered).alias("p"), canonical_row(a.drop(ordered)).alias("x"))
        y = b.select(F.col(ordered).alias("q"), canonical_row(b.drop(ordered)).alias("y"))
        return x.join(y, F.col("p") == F.col("q"), "full").where(~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).isEmpty()
    return differences(a, b).isEmpty()


def project_answer(df: DataFrame, answer: list[str] | None) -> tuple[DataFrame, str]:
    """The answer's columns of a result and how they were found: none asked, by-name, as-is (as many), unmatched."""
    if not answer:
        return df, "none"
    here = {c.lower(): c for c in df.columns}
    if all(a.lower() in here for a in answer):
        return df.select(*[F.col(f"`{here[a.lower()]}`") for a in answer]), "by-name"
    return (df, "as-is") if len(df.columns) == len(answer) else (df, "unmatched")


def score(gold: DataFrame | None, got: DataFrame | None, answer: list[str] | None = None) -> tuple[bool | None, str]:
    """(passed, reason); None, not False, where the gold result itself is unusable."""
    if gold is None:
        return None, "no gold result"
    want, how = project_answer(gold, answer)
    if how in ("as-is", "unmatched") and answer:
        return None, "gold lacks the answer's columns"
    if got is None:
        return False, "no-sql"
    have, how = project_answer(got, answer)
    if how == "unmatched":
        return False, "columns_unmatched"
    return (True, "match") if same_rows(want, have) else (False, "rows differ")


def id_differences(recorded: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """id and the side that lacks it, 'recorded' or 'live'."""
    a, b = recorded.select(key).distinct().withColumn("r", F.lit(1)), live.select(key).distinct().withColumn("l", F.lit(1))
    lacks = F.when(F.col("r").isNull(), "recorded").when(F.col("l").isNull(), "live")
    return a.join(b, key, "full").select(key, lacks.alias("lacking")).where("lacking is not null")


def numbers_of(text: str | None) -> list[str]:
    return [x.replace(",", "") for x in re.findall(NUMBER, text or "")]


def unreproduced(claim: str, rows: list[tuple], sql: str = "", row_cap: int = 5000) -> list[str]:
    """Numbers of a claim that a live result doesn't bear out: as a cell, within one, as its whole part, as the number of
    rows, or rounded to the claim's own decimals. Numbers of the query itself prove nothing either way, and a result cut
    at the cap can't disprove large ones."""
    cells = {str(c) for r in rows for c in r if c is not None}
    cells |= {n for c in set(cells) for n in numbers_of(c)}
    live = {float(n) for c in cells for n in numbers_of(c)} | {float(len(rows))}
    asked, cut, out = set(numbers_of(sql)), len(rows) >= row_cap, []
    for n in numbers_of(claim):
        places = len(n.partition(".")[2])
        v = float(n)
        fits = n in cells or v in live or any(float(int(x)) == v or (places and round(x, places) == v) for x in live)
        if not fits and n not in asked and not (cut and v >= row_cap):
            out.append(n)
    return out


def is_empty_result(rows: list[tuple]) -> bool:
    """No rows, or a single number 0 of any kind, such as a count; a truth value is an answer."""
    if len(rows) == 1 and len(rows[0]) == 1:
        [value] = rows[0]
        return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) and value == 0
    return not rows


def level_of(count: Column) -> Column:
    """L1 for one, L2 for two to four, L3 for more; null for none."""
    return F.when(count == 1, "L1").when(count.between(2, 4), "L2").when(count >= 5, "L3")


# Survivor windows of each subtype.
WINDOWS = {"filter-read": (2, 10), "filter-synthesize": (5, 20), "filter-compare": (2, 20), "filter-survey": (5, 60)}
SURVIVOR_CEILING = 200


def in_window(subtype: Column, count: Column) -> Column:
    """Whether a filter's survivors suit its subtype; null for an unknown one."""
    out = F.lit(None).cast("boolean")
    for name, (low, high) in WINDOWS.items():
        out = F.when(subtype == name, count.between(low, high) & (count <= SURVIVOR_CEILING)).otherwise(out)
    return out


def one_reading(paths: DataFrame, term: str) -> DataFrame:
    """path, title, n, verdict of each place that a term names: PASS when only one does, WARN when several do."""
    hit = F.lower("title").eqNullSafe(F.lit(term.lower())) | F.contains(F.lower(F.concat(F.lit("/"), F.col("path"), F.lit("/"))), F.lit(f"/{term.lower()}/"))
    found = paths.where(hit).groupBy("path", "title").agg(F.countDistinct("id").alias("n"))
    n = found.count()
    return found.withColumn("verdict", F.lit("PASS" if n == 1 else "WARN"))
