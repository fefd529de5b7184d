"""Data quality: null profiles and named checks as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

CHECK = "name string, observed string, ok boolean"


def null_profile(df: DataFrame) -> DataFrame:
    """column, n_null, n_value of every column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"c{i}").alias("n_value")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


class Suite:
    """Checks that add up to one frame: name, observed, ok."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, name: str, one_row: DataFrame, observed: Column, ok: Column) -> Suite:
        self.parts.append(one_row.select(F.lit(name).alias("name"), observed.cast("string").alias("observed"), F.coalesce(ok, F.lit(False)).alias("ok")))
        return self

    def unique(self, name: str, df: DataFrame, *keys: str) -> Suite:
        again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("x"))
        return self.add(name, again, F.col("x"), F.col("x") == 0)

    def subset(self, name: str, df: DataFrame, column: str, allowed: list) -> Suite:
        off = df.agg(F.count_if(~F.col(column).isin(allowed)).alias("x"))
        return self.add(name, off, F.col("x"), F.col("x") == 0)

    def inside(self, name: str, df: DataFrame, column: str, low, high) -> Suite:
        off = df.agg(F.count_if(~F.col(column).between(low, high)).alias("x"))
        return self.add(name, off, F.col("x"), F.col("x") == 0)

    def no_orphans(self, name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> Suite:
        lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti").agg(F.count(F.lit(1)).alias("x"))
        return self.add(name, lost, F.col("x"), F.col("x") == 0)

    def exactly_one(self, name: str, df: DataFrame, key: str, condition: Column, parent: DataFrame | None = None, parent_key: str | None = None) -> Suite:
        """Every key has one row that meets the condition; keys of a parent without such a row count as well."""
        n = df.groupBy(F.col(key).alias("__k")).agg(F.count_if(condition).alias("n"))
        if parent is not None:
            n = parent.select(F.col(parent_key).alias("__p")).distinct().join(n, F.col("__p") == F.col("__k"), "left")
        return self.add(name, n.agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("x")), F.col("x"), F.col("x") == 0)

    def equal(self, name: str, one_row: DataFrame, observed: Column, wanted) -> Suite:
        return self.add(name, one_row, observed, observed == F.lit(wanted))

    def values(self, name: str, df: DataFrame, column: str, wanted: list[str]) -> Suite:
        """The known values of a column are exactly these; observed are those that are more or fewer."""
        held = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
        should = held.sparkSession.createDataFrame([(w,) for w in wanted], "w string")
        off = held.join(should, F.col("v") == F.col("w"), "full").where("v is null or w is null").select(F.coalesce("v", "w").alias("x"))
        return self.add(name, off.agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("x")), F.col("x"), F.col("x") == "")

    def share(self, name: str, df: DataFrame, condition: Column, least: float) -> Suite:
        one = df.agg(F.round(F.count_if(condition) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("x"))
        return self.add(name, one, F.col("x"), F.col("x") >= least)

    def median_difference(self, name: str, pairs: DataFrame, stated: str, summed: str, most: float) -> Suite:
        gap = F.abs(F.col(summed) - F.col(stated)) / F.nullif(F.col(stated), F.lit(0))
        middle = quantiles(pairs, [], gap, {"x": 0.5}).select(F.round("x", 6).alias("x"))
        return self.add(name, pairs.sparkSession.range(1).join(middle, F.lit(True), "left"), F.col("x"), F.col("x") < most)

    def result(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


def report_load(reports: DataFrame, n_sources: int, summary: DataFrame, projects: DataFrame, least_chars: int = 100, most_bare: float = 0.02) -> DataFrame:
    """The checks of loaded reports (rcn, id, project_id, text): all sources parsed, one report for each summary row, no
    orphans, ids that begin with their project, and texts of more than some characters in all but a few."""
    n = reports.agg(F.count(F.lit(1)).alias("x"))
    lost = summary.select(F.col("rcn").alias("s")).join(reports.select("rcn"), F.col("s") == F.col("rcn"), "left_anti").agg(F.count(F.lit(1)).alias("x"))
    apart = reports.agg(F.count_if(F.col("project_id").cast("string") != F.substring_index("id", "_", 1)).alias("x"))
    bare = reports.agg(F.count_if(F.coalesce(F.length("text"), F.lit(0)) <= least_chars).alias("x"), F.count(F.lit(1)).alias("n"))
    return (
        Suite()
        .equal("all sources parsed", n, F.col("x"), n_sources)
        .add("a report for each summary row", lost, F.col("x"), F.col("x") == 0)
        .no_orphans("project exists", reports, "project_id", projects, "id")
        .add("id begins with its project", apart, F.col("x"), F.col("x") == 0)
        .add("text present", bare, F.col("x"), F.col("x") < F.col("n") * most_bare)
        .result()
    )


def regression(tables: dict[str, DataFrame], documented: dict[str, dict]) -> DataFrame:
    """name, observed, ok of documented facts of tables: {table: {rows, columns, values: {column: [..]}, nulls: {column: n},
    range: {column: (low, high)}}}; facts that aren't given aren't checked."""
    suite = Suite()
    for name, facts in documented.items():
        df = tables[name]
        if "columns" in facts:
            off = ",".join(sorted(set(df.columns) ^ set(facts["columns"])))
            one = df.sparkSession.range(1)
            suite.add(f"{name}: columns", one, F.lit(off), F.lit(off == ""))
        if "rows" in facts:
            suite.equal(f"{name}: rows", df.agg(F.count(F.lit(1)).alias("x")), F.col("x"), facts["rows"])
        for column, wanted in facts.get("values", {}).items():
            suite.values(f"{name}.{column}: values", df, column, wanted)
        for column, n in facts.get("nulls", {}).items():
            suite.equal(f"{name}.{column}: nulls", df.agg(F.count_if(F.col(column).isNull()).alias("x")), F.col("x"), n)
        for column, (low, high) in facts.get("range", {}).items():
            suite.inside(f"{name}.{column}: range", df, column, low, high)
    return suite.result()


def schema_check(actual: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """table, problem: what a catalog (table, column) lacks or has beyond the documented columns."""
    spark = actual.sparkSession
    want = spark.createDataFrame([(t, c) for t, cs in expected.items() for c in cs], "table string, column string")
    have = actual.select("table", "column").withColumn("here", F.lit(1))
    both = want.withColumn("documented", F.lit(1)).join(have, ["table", "column"], "full")
    problem = F.when(F.col("here").isNull(), F.concat(F.lit("missing column "), F.col("column"))).when(F.col("documented").isNull(), F.concat(F.lit("undocumented column "), F.col("column")))
    return both.select("table", problem.alias("problem")).where("problem is not null")
