"""Readers and sinks: defective delimited text, XML reports, JSON lines, Markdown, vectors, samples."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..storage import file_system

# ---- delimited text with literal ";" between quotes


def delimited_fields(line: Column) -> Column:
    """Fields of a line whose records are quoted and parted by '";"': empty fields may lack their quotes, inner quotes
    are doubled. Null when the line isn't quoted as a whole."""
    s = F.regexp_replace(line, r"^﻿|[\r\n]+$", "")
    s = F.regexp_replace(s, ";(?=;)", ';""')  # between two separators
    s = F.regexp_replace(F.regexp_replace(s, "^;", '"";'), ";$", ';""')
    inner = F.substr(s, F.lit(2), F.length(s) - 2)
    fields = F.transform(F.split(inner, '";"'), lambda f: F.replace(f, F.lit('""'), F.lit('"')))
    return F.when((F.length(s) >= 2) & s.startswith('"') & s.endswith('"'), fields)


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records as text columns named by the header line, and rejected lines with what is wrong."""
    header = spark.read.text(path).where(F.length("value") > 0).select(delimited_fields(F.col("value")).alias("f")).head()
    if header is None or header["f"] is None:
        raise ValueError(f"{path} has no quoted header")
    names = header["f"]
    rows = spark.read.text(path).where(F.length("value") > 0).select("value", delimited_fields(F.col("value")).alias("f"))
    is_header = F.coalesce(F.col("f") == F.array(*[F.lit(n) for n in names]), F.lit(False))
    good = rows.where(~is_header & (F.size("f") == len(names))).select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    why = F.when(F.col("f").isNull(), "not quoted").otherwise(F.concat(F.size("f").cast("string"), F.lit(" fields")))
    bad = rows.where(F.col("f").isNull() | (F.size("f") != len(names))).select("value", why.alias("problem"))
    return good, bad


def typed(raw: Column, kind: str) -> Column:
    """A text field as a type: empty is null, decimals may have a comma, what can't be cast is null."""
    x = F.nullif(raw, F.lit(""))
    if kind.startswith("decimal"):
        x = F.replace(x, F.lit(","), F.lit("."))
    return x if kind == "string" else x.try_cast(kind)


def typed_table(raw: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """source column -> (target, type); the columns must be exactly those of the mapping."""
    if set(raw.columns) != set(mapping):
        raise ValueError(f"columns differ: missing {sorted(set(mapping) - set(raw.columns))}, unknown {sorted(set(raw.columns) - set(mapping))}")
    return raw.select(*[typed(F.col(f"`{c}`"), kind).alias(name) for c, (name, kind) in mapping.items()])


def cast_losses(raw: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """column, n_lost: fields with text that a cast turns to null, for every column that isn't text, in one pass."""
    checked = [(c, name, kind) for c, (name, kind) in mapping.items() if kind != "string"]
    lost = lambda c, kind: F.count_if(F.nullif(F.col(f"`{c}`"), F.lit("")).isNotNull() & typed(F.col(f"`{c}`"), kind).isNull())
    one = raw.agg(*[lost(c, kind).alias(f"c{i}") for i, (c, _, kind) in enumerate(checked)])
    pairs = [F.struct(F.lit(name).alias("column"), F.col(f"c{i}").alias("n_lost")) for i, (_, name, _) in enumerate(checked)]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def write_delimited(df: DataFrame, path: str) -> None:
    """Text columns as RFC 4180 files with a header: every field quoted, quotes doubled, line breaks kept inside."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    df.select(*cols).write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """RFC 4180 files as text columns, none of them null; lines of any length. names: the header, where it is known, so
    that no file is read for it."""
    r = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("maxCharsPerColumn", "-1").option("nullValue", "\u0000").option("emptyValue", "")
    if names:
        r = r.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return r.csv(path).na.fill("")


def write_typed(raw: DataFrame, mapping: dict[str, tuple[str, str]], path: str) -> DataFrame:
    """Writes a staged table as a typed one, replacing what is there, and gives the stored table."""
    typed_table(raw, mapping).write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path)


# ---- XML, JSON lines, Markdown


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Rows of an XML file; a malformed one gives nulls and its text in _corrupt_record."""
    s = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if "_corrupt_record" not in s.names:
        s = T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(s).load(path)


def _jsonl(spark: SparkSession, path: str | list[str], schema: str, exclude: str | None) -> DataFrame:
    s = T.StructType.fromDDL(schema).add("_bad", "string")
    rows = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    if exclude:
        rows = rows.where(~F.contains(F.col("file"), F.lit(exclude)))
    return rows.withColumn("label", F.element_at(F.split("file", "/"), -2))


def read_xml_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Files that each hold one XML record: (file and the record's fields of those that parse, file and text of each that
    doesn't, or whose fields don't fit the schema). A bad file costs a row of the second, not the run; files without a byte
    aren't read."""
    fields = T.StructType.fromDDL(schema)
    parsed = F.from_xml("value", fields.add("_bad", "string").simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # Parsed with all its fields: read for one of them alone, a record wouldn't show that another doesn't fit.
    whole = let(parsed, lambda x: F.struct((x.isNull() | x["_bad"].isNotNull()).alias("ill"), x.alias("record")))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", whole.alias("x"))
    good = rows.where("not x.ill").select("file", *[F.col(f"x.record.`{f.name}`").alias(f.name) for f in fields if f.name != "_bad"])
    return good, rows.where("x.ill").select("file", F.col("value").alias("text"))


def bad_lines(spark: SparkSession, path: str | list[str], schema: str, exclude: str | None = None) -> DataFrame:
    """file, label, line: every line below a path that is no JSON of the schema; empty lines are no lines."""
    s = T.StructType.fromDDL(schema).add("_bad", "string")
    rows = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("file", F.col("_metadata.file_path"))
    if exclude:
        rows = rows.where(~F.contains(F.col("file"), F.lit(exclude)))
    told = F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.where(F.trim("value") != "").withColumn("bad", told["_bad"])
    return rows.where("bad is not null").select("file", F.element_at(F.split("file", "/"), -2).alias("label"), F.col("bad").alias("line"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, exclude: str | None = None) -> DataFrame:
    """JSON lines below a path, with file and label (the file's folder). strict: raises if there are bad lines, and tells
    how many each file has and the first of each; bad_lines() gives them all. Else they are left out. exclude: part of
    a path that drops a file."""
    rows = _jsonl(spark, path, schema, exclude)
    if strict:
        found = bad_lines(spark, path, schema, exclude)
        bad = found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).orderBy("file").collect()  # a row for each bad file
        if bad:
            raise ValueError("; ".join(f"{r['file']}: {r['n']} bad lines, such as {r['first'][:80]}" for r in bad))
        return rows.drop("_bad")
    return rows.where("_bad is null").drop("_bad")


def _after(parts: Column) -> Column:
    """What follows the first piece."""
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def markdown_sections(text: Column) -> Column:
    """(title, body) of each second-level heading."""
    parts = _after(F.split(F.concat(F.lit("\n"), text), r"\n## "))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("title"), F.trim(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("body")))


def markdown_rows(text: Column) -> Column:
    """Cells of each row of the pipe tables in a text, without headings' rules."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def allocation(text: Column) -> Column:
    """(route, level, target) of an allocation table: rows whose first cell names a route and whose others are counts, one
    for each level that the table's heading names. A total, in row or column, is left out."""
    rows = markdown_rows(text)
    head = F.get(rows, F.lit(0))
    body = F.filter(rows, lambda r, i: (i > 0) & ~F.lower(F.get(r, F.lit(0))).startswith("total"))
    count = lambda c: F.regexp_extract(c, r"^\**\s*([0-9]+)", 1).try_cast("int")
    name = lambda c: F.trim(F.regexp_replace(c, r"[*`]", ""))
    cells = F.transform(body, lambda r: F.transform(F.slice(r, F.lit(2), F.size(r) - 1), lambda c, i: F.struct(name(F.get(r, F.lit(0))).alias("route"), name(F.get(head, i + 1)).alias("level"), count(c).alias("target"))))
    return F.filter(F.flatten(cells), lambda x: x["target"].isNotNull() & ~F.lower(x["level"]).startswith("total"))


def frontier_rows(text: Column) -> Column:
    """(bucket, n, status) of a frontier's table: 'first / second' of a taxonomy, a count with or without separators, a
    status; other rows are none."""
    fits = F.filter(markdown_rows(text), lambda r: (F.size(r) >= 3) & F.contains(F.get(r, F.lit(0)), F.lit(" / ")) & F.get(r, F.lit(1)).rlike(r"^[0-9][0-9,]*$"))
    return F.transform(fits, lambda r: F.struct(F.get(r, F.lit(0)).alias("bucket"), F.replace(F.get(r, F.lit(1)), F.lit(",")).cast("bigint").alias("n"), F.get(r, F.lit(2)).alias("status")))


def id_blocks(text: Column) -> Column:
    """(id, body) of each block that a line '- id: X' opens."""
    parts = _after(F.split(F.concat(F.lit("\n"), text), r"\n\s*-\s*id:\s*"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("id"), F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p)).alias("body")))


# ---- vectors, journals


def save_index(vectors: DataFrame, path: str, model: str, dim: int, weights: str = "") -> None:
    """Vectors as Parquet, and beside them what a reader must know: the model, the hash of its weights, the dimension."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = json.dumps({"model": model, "weights": weights, "dim": dim, "rows": vectors.count()})
    vectors.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, model: str, dim: int, weights: str = "") -> DataFrame:
    """Refuses an index of another model, other weights, another dimension or count."""
    meta = json.loads(spark.read.text(f"{path}/meta").head()["value"])
    vectors = spark.read.parquet(f"{path}/vectors")
    if (meta["model"], meta["dim"]) != (model, dim):
        raise ValueError(f"the index is of {meta['model']} with {meta['dim']} dimensions")
    if meta.get("weights", "") != weights:
        raise ValueError("the index is of other weights of that model")
    if meta["rows"] != vectors.count():
        raise ValueError("the index is incomplete")
    return vectors


def append_journal(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds lines to a journal; each write is one committed set of files. batch names the write: one that is tried again
    under its name replaces what it wrote before, so that no line counts twice."""
    name = batch or uuid.uuid4().hex
    rows.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/batch={name}")


# ---- reports


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a pipe table, in its order; pipes within cells are escaped. Larger frames are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report's table holds at most {most} rows: aggregate first")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line([cell(v) for v in r]) for r in rows]])


def report(sections: list[tuple[str, DataFrame | str]], title: str) -> str:
    """A Markdown report: a title, and for each section a heading and its table or text."""
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"


def with_section(text: str, name: str, body: str) -> str:
    """A report with one section new or replaced; the others stay as they are."""
    kept = [b for b in ("\n" + text).split("\n## ")[1:] if b.split("\n", 1)[0].strip() != name]
    head = ("\n" + text).split("\n## ")[0].strip()
    return "\n\n".join([head, *[f"## {b.strip()}" for b in kept], f"## {name}\n\n{body.strip()}"]) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text as one file at a path of any file system, replacing what is there."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


# ---- samples, lookups, catalog


def hash_sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones each time: the smallest by a hash of their keys."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *keys)).orderBy("__h", *keys).limit(n).drop("__h")


def stratified_sample(df: DataFrame, n: int, stratum: str, key: str, weight: Column | None = None, seed: str = "sample-1", fans: int = 64) -> DataFrame:
    """Exactly n rows of each stratum (or all), the same ones each time, drawn without replacement in proportion to a
    weight, with place (from 1). A row's key is -ln(u) / weight, u a uniform number from a seeded hash; the least n keys
    are the sample. Tasks keep the least n of their strata, some of them merge theirs, and one merges those: what one task
    orders are fans * n rows at most. Rows whose weight is null or not positive are never drawn."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    drawn = df.withColumn("__w", w).where(F.col("__w") > 0).withColumn("__k", -F.log((hashed.cast("double") + 0.5) / F.lit(float(16**13))) / F.col("__w"))
    order = [F.col("__k"), F.col(key)]
    least = lambda rows, by: rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
    some = least(drawn.withColumn("__fan", F.pmod(F.spark_partition_id(), F.lit(fans))), [stratum, "__fan"]).drop("place")
    return least(some, [stratum]).drop("__w", "__k", "__fan")


def by_ids(df: DataFrame, key: str, ids: list[int], few: int = 1000) -> DataFrame:
    """Rows of given ids: a pushed-down list, or a semi-join beyond a few."""
    if len(ids) <= few:
        return df.where(F.col(key).isin(ids))
    wanted = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("__id", df.schema[key].dataType)]))
    return df.join(wanted, df[key] == F.col("__id"), "left_semi")


def catalog(spark: SparkSession) -> DataFrame:
    """table, position, column and type of every registered view."""
    rows = [(t.name, i, c.name, c.dataType) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")
