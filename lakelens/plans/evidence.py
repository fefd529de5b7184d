"""Queries over sources, statements, records and checks: operators that work on files, statements or a bank's records run
over written tables or over records given inline, as SQL does beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as tx
from ..functions import vector
from ..operators import bankfile, chunking, compare, guard, lexicon, quality, records, retrieval, runs, scoped, similarity, verify
from ..sources import readers
from ..storage import new_path
from .relational import big, paths, t
from .textual import _LEGS, _PATHS_SQL, _RECORD, _RERANKED, PARAGRAPHS, asked, bag_vector, holding, legs, neighbours, texts, topic

QUERIES, SQL = {}, {}
#: The same for operators over records given inline: they read no table, so they are tests and no queries.
CASES, CASE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def case(sql: str):
    def keep(f):
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return keep


def inline(spark, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- sources and sinks


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, '' AS gap, 'say "' || n_name || '"' AS quoted FROM nation""")
def delimited_lines(spark, d):
    line = F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('";"'), F.col("n_name"), F.lit('";;"say ""'), F.col("n_name"), F.lit('"""'))
    f = t(spark, d, "nation").select(readers.delimited_fields(line).alias("f"))
    return f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("key", "name", "gap", "quoted"))])


@query("""SELECT o_orderkey, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, CAST(o_orderdate AS DATE) AS day,
       'a "' || o_orderpriority || '"' || chr(10) || ';b, c' AS note FROM orders""")
def csv_round_trip(spark, d):
    """Staged as RFC 4180 text, read back as text, cast and stored as a typed table."""
    note = F.concat(F.lit('a "'), F.col("o_orderpriority"), F.lit('"\n;b, c'))
    total = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    raw = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), total.alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), note.alias("note"))
    staged = new_path(spark, "staged-csv")
    readers.write_delimited(raw, staged)
    mapping = {"key": ("o_orderkey", "bigint"), "status": ("status", "string"), "total": ("total", "decimal(18,2)"), "day": ("day", "date"), "note": ("note", "string")}
    return readers.write_typed(readers.read_csv(spark, staged, list(mapping)), mapping, new_path(spark, "typed")).withColumn("total", F.col("total").cast("double"))


@query("SELECT p_partkey AS rcn, p_name AS title, p_brand AS brand, CAST(2 AS BIGINT) AS n_related, p_partkey + 1 AS other FROM part")
def xml_reports(spark, d):
    """XML files of some hundred parts each, an element for each part, with nested relations."""
    key, after = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    row = F.concat(F.lit("<report><rcn>"), key, F.lit("</rcn><title>"), F.col("p_name"), F.lit('</title><relations kind="'), F.col("p_brand"), F.lit('"><item>'), key, F.lit("</item><item>"), after, F.lit("</item></relations></report>"))
    folder = new_path(spark, "xml")
    parts = t(spark, d, "part")
    file = F.pmod(F.xxhash64("p_partkey"), F.lit(max(1, parts.count() // 400)))
    files = parts.groupBy(file.alias("file")).agg(F.array_join(F.collect_list(row), "\n").alias("all"))
    files.select(F.concat(F.lit("<reports>\n"), F.col("all"), F.lit("\n</reports>")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    r = readers.read_xml(spark, folder, "report", "rcn bigint, title string, relations struct<_kind: string, item: array<bigint>>")
    return r.select("rcn", "title", F.col("relations._kind").alias("brand"), big(F.size("relations.item")).alias("n_related"), F.col("relations.item")[1].alias("other"))


@query("""SELECT CASE WHEN n_name NOT LIKE '%I%' THEN CAST(n_nationkey AS BIGINT) END AS id, CASE WHEN n_name NOT LIKE '%I%' THEN n_name END AS title, n_name LIKE '%I%' AS bad FROM nation""")
def xml_files(spark, d):
    """A file for each nation, some of them cut off: those that parse give rows, each other one an error."""
    whole = F.concat(F.lit("<result><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><title>"), F.col("n_name"), F.lit("</title></result>"))
    text = F.when(F.contains(F.col("n_name"), F.lit("I")), F.substring(whole, 1, 30)).otherwise(whole)
    folder = new_path(spark, "xml-files")
    t(spark, d, "nation").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    good, ill = readers.read_xml_files(spark, folder, "id bigint, title string")
    return good.select("id", "title", F.lit(False).alias("bad")).unionByName(ill.select(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("bad")))


def _journals(spark, d) -> str:
    folder, c = new_path(spark, "jsonl"), t(spark, d, "conversations").select("conv_id", "turn", "role")
    c.where("role = 'user'").write.json(f"{folder}/archive")
    c.where("role <> 'user'").write.json(f"{folder}/live")
    return folder


@query("SELECT conv_id, turn, role, 'live' AS label FROM conversations WHERE role <> 'user'")
def jsonl_sources(spark, d):
    rows = readers.read_jsonl(spark, _journals(spark, d), "conv_id bigint, turn bigint, role string", exclude="/archive/")
    return rows.select("conv_id", "turn", "role", "label")


@query("SELECT '{\"name\": ' || n_name AS line, 'notes' AS label FROM nation WHERE n_regionkey < 2")
def jsonl_bad_lines(spark, d):
    folder, n = new_path(spark, "bad-jsonl"), t(spark, d, "nation")
    n.select(F.concat(F.lit('{"name": '), F.when(F.col("n_regionkey") < 2, F.col("n_name")).otherwise(F.concat(F.lit('"'), F.col("n_name"), F.lit('"}')))).alias("value")).write.text(f"{folder}/notes")
    return readers.bad_lines(spark, folder, "name string").select("line", "label")


@query("""SELECT r_regionkey, r_name || ',Blocks' AS titles, CAST(1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS BIGINT) AS n_rows, 'q' || r_regionkey AS block, 'about ' || r_name AS body FROM region""")
def markdown_parts(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), F.col("n_name"), F.lit(" | x |")))), "\n").alias("rows"))
    r = t(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    text = F.concat(F.lit("intro\n## "), F.col("r_name"), F.lit("\n| name | y |\n|---|---|\n"), F.col("rows"), F.lit("\n## Blocks\n- id: q"), F.col("r_regionkey").cast("string"), F.lit("\nabout "), F.col("r_name"))
    r = r.select("r_regionkey", text.alias("text"))
    block = F.get(readers.id_blocks(F.col("text")), F.lit(0))
    return r.select("r_regionkey", F.array_join(F.transform(readers.markdown_sections(F.col("text")), lambda s: s["title"]), ",").alias("titles"), big(F.size(readers.markdown_rows(F.col("text")))).alias("n_rows"), block["id"].alias("block"), block["body"].alias("body"))


_PLAN = "### Allocation\n\n| route | L1 | L2 | total |\n|---|---:|---:|---|\n| **F** | 500 | 20 (at most) | 520 |\n| `O` | 7 | - | 7 |\n| Total | 507 | 20 | 527 |\n"


@case("SELECT * FROM (VALUES ('F', 'L1', 500), ('F', 'L2', 20), ('O', 'L1', 7)) x(route, level, target)")
def allocation_table(spark, d):
    return inline(spark, "text string", [(_PLAN,)]).select(F.explode(readers.allocation(F.col("text"))).alias("x")).select("x.*")


@query("SELECT r_name || ' / second' AS bucket, CAST(r_regionkey * 1000 + 1234 AS BIGINT) AS n, 'mined' AS status FROM region")
def frontier_table(spark, d):
    r = t(spark, d, "region")
    text = F.concat(F.lit("| bucket | n | status |\n|---|---|---|\n| "), F.col("r_name"), F.lit(" / second | "), F.format_number(F.col("r_regionkey") * 1000 + 1234, 0), F.lit(" | mined |\n| none | 3 | - |"))
    return r.select(F.explode(readers.frontier_rows(text)).alias("x")).select("x.*")


@query("""SELECT route AS o_orderstatus, level AS urgency, target, coalesce(f, 0) AS filled, coalesce(s, 0) AS staged, greatest(target - coalesce(f, 0) - coalesce(s, 0), 0) AS missing
FROM (VALUES ('F', 'L1', CAST(500 AS BIGINT)), ('F', 'L2', 20), ('O', 'L1', 7)) x(route, level, target)
LEFT JOIN (SELECT o_orderstatus, 'L' || substr(o_orderpriority, 1, 1) AS u, count(*) AS f FROM orders WHERE o_totalprice > 200000 GROUP BY 1, 2) a ON a.o_orderstatus = route AND a.u = level
LEFT JOIN (SELECT o_orderstatus, 'L' || substr(o_orderpriority, 1, 1) AS u, count(*) AS s FROM orders WHERE o_totalprice < 2000 GROUP BY 1, 2) b ON b.o_orderstatus = route AND b.u = level""")
def gap_report(spark, d):
    o = t(spark, d, "orders").withColumn("urgency", F.concat(F.lit("L"), F.substring("o_orderpriority", 1, 1)))
    targets = allocation_table(spark, d).select(F.col("route").alias("o_orderstatus"), F.col("level").alias("urgency"), big(F.col("target")).alias("target"))
    return records.gaps(o.where("o_totalprice > 200000"), o.where("o_totalprice < 2000"), targets, ["o_orderstatus", "urgency"])


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dim FROM embeddings")
def index_round_trip(spark, d):
    path = new_path(spark, "vector-index")
    readers.save_index(t(spark, d, "embeddings").select("vec_id", "embedding"), path, "bag", 64, "w1")
    return readers.load_index(spark, path, "bag", 64, "w1").select("vec_id", F.size("embedding").alias("dim"))


@query("SELECT * FROM (VALUES ('same', ''), ('other model', 'the index is of bag with 64 dimensions'), ('other weights', 'the index is of other weights of that model'), ('other dimension', 'the index is of bag with 64 dimensions')) x(asked, refusal)")
def index_guard(spark, d):
    path, rows = new_path(spark, "vector-index"), []
    readers.save_index(t(spark, d, "embeddings").select("vec_id", "embedding"), path, "bag", 64, "w1")
    for name, *asked_for in (("same", "bag", 64, "w1"), ("other model", "x", 64, "w1"), ("other weights", "bag", 64, "w2"), ("other dimension", "bag", 32, "w1")):
        try:
            readers.load_index(spark, path, *asked_for)
            rows.append((name, ""))
        except ValueError as e:
            rows.append((name, str(e)))
    return inline(spark, "asked string, refusal string", rows)


@query("""SELECT vec_id, CASE WHEN label = 1 THEN 'norm' WHEN label = 2 THEN 'dimension' WHEN label = 3 THEN 'not finite' ELSE '' END AS problems FROM embeddings""")
def vector_guard(spark, d):
    e = F.col("embedding")
    bent = F.when(F.col("label") == 1, F.transform(e, lambda x: x * 2)).when(F.col("label") == 2, F.concat(e, F.array(F.lit(0.0).cast("float")))).when(F.col("label") == 3, F.transform(e, lambda x, i: F.when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(e)
    return t(spark, d, "embeddings").select("vec_id", bent.alias("v")).select("vec_id", F.array_join(vector.problems(F.col("v"), 64), ",").alias("problems"))


@query("SELECT role, 2 * count(*) AS n FROM conversations GROUP BY 1")
def journal_append(spark, d):
    """Two batches, the first of which is written again, as after a failure."""
    path, c = new_path(spark, "journal"), t(spark, d, "conversations").select("conv_id", "turn", "role")
    for batch in ("a", "a", "b"):
        readers.append_journal(c, path, batch)
    return spark.read.json(path).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(row_number() OVER (ORDER BY o, r) AS INT) AS line_no, line FROM (
  SELECT 0 AS o, 0 AS r, '# Corpus' AS line UNION ALL SELECT 1, 0, '' UNION ALL SELECT 2, 0, '## Regions' UNION ALL SELECT 3, 0, '' UNION ALL SELECT 4, 0, '| region | n |' UNION ALL SELECT 5, 0, '| --- | --- |'
  UNION ALL SELECT 6, r_regionkey, '| ' || r_name || ' | ' || (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) || ' |' FROM region
  UNION ALL SELECT 7, 0, '' UNION ALL SELECT 8, 0, '## Notes' UNION ALL SELECT 9, 0, '' UNION ALL SELECT 10, 0, 'new')""")
def report_lines(spark, d):
    """A report written to a file, one section of it replaced, and read back."""
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    table = t(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).orderBy("r_regionkey").select(F.col("r_name").alias("region"), "n")
    path = f"{new_path(spark, 'report')}/report.md"
    readers.write_text(spark, path, readers.with_section(readers.report([("Notes", "old"), ("Regions", table)], "Corpus"), "Notes", "new"))
    whole = spark.read.text(path, wholetext=True).select(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n").alias("l"))
    return whole.select(F.posexplode("l").alias("line_no", "line")).select((F.col("line_no") + 1).alias("line_no"), "line")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT * FROM range(1, 6000, 4))")
def lookup_by_ids(spark, d):
    return readers.by_ids(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", list(range(1, 6000, 4)))


@query("""SELECT table_name AS "table", CAST(ordinal_position - 1 AS INT) AS position, column_name AS "column" FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'part')""")
def catalog_columns(spark, d):
    names = ["region", "nation", "part"]
    for n in names:
        t(spark, d, n).createOrReplaceTempView(n)
    return readers.catalog(spark).where(F.col("table").isin(names)).select("table", "position", "column")


# ---- predicates, aggregates, functions


@query("SELECT source, count(*) FILTER (WHERE coalesce(nullif(trim(lang), ''), nullif(trim(text), '')) IS NOT NULL) AS with_text FROM documents GROUP BY 1")
def text_presence(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count_if(tx.has_text(F.col("lang"), F.col("text"))).alias("with_text"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1.5 * (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def having_above_average(spark, d):
    counts = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.join(F.broadcast(mean), F.col("n") > 1.5 * F.col("mean")).select("o_custkey", "n")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority SIMILAR TO '[1-3]-(URGENT|HI.*)' GROUP BY 1")
def similar_to(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderpriority").rlike("^(?:[1-3]-(URGENT|HI.*))$")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models, CAST(sum(event_id % 100) AS BIGINT) AS total, CAST(coalesce(sum(event_id % 100) FILTER (WHERE event_type = 'click'), -1) AS BIGINT) AS clicks FROM events GROUP BY 1")
def usage_rollup(spark, d):
    u = t(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 100).alias("tokens"))
    r = records.rolled_up(u, "user_id", "event_type", "tokens")
    return r.select("user_id", F.array_join("models", ",").alias("models"), big(F.col("total")).alias("total"), big(F.coalesce(F.col("by_model")["click"], F.lit(-1))).alias("clicks"))


@query("SELECT lang, l[len(l) // 2 + 1] AS upper_median FROM (SELECT lang, list_sort(list(n_chars)) AS l FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)")
def upper_medians(spark, d):
    return records.upper_median(t(spark, d, "documents"), ["lang"], "n_chars")


_POOL = [(1, "sql", "L1"), (2, "sql", "L2"), (3, "hybrid", "L1"), (4, "hybrid", "L1"), (5, "vector", "L3"), (6, "vector", "L1"), (7, "sql", "L1")]


@case("SELECT * FROM (VALUES (1, 1), (2, 5), (3, 3), (4, 2), (5, 4)) x(place, id)")
def balanced_picks(spark, d):
    picked = records.balanced_pick([{"id": i, "route": r, "level": v} for i, r, v in _POOL], 5, ("route", "level"))
    return inline(spark, "place int, id int", [(n + 1, p["id"]) for n, p in enumerate(picked)])


@query("""SELECT o_orderkey, list_sort(list(c)) AS cohorts FROM (SELECT o_orderkey, 'dear' AS c FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'final' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1 HAVING count(*) > 1""")
def cohort_overlaps(spark, d):
    o = t(spark, d, "orders")
    return records.overlaps({"final": o.where("o_orderstatus = 'F'"), "urgent": o.where("o_orderpriority LIKE '1%'"), "dear": o.where("o_totalprice > 300000")}, "o_orderkey")


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint FROM documents")
def text_fingerprints(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))


@query("""SELECT r_regionkey, entity, context FROM region, LATERAL (VALUES ('&lt;', 'cost &lt; 1M &amp; ' || r_name), ('&amp;', 'cost &lt; 1M &amp; ' || r_name), ('&#x2013;', 'a &#x2013; b')) x(entity, context) WHERE (r_regionkey % 2 = 0) = (entity <> '&#x2013;')""")
def entity_contexts(spark, d):
    told = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("cost &lt;  1M\n&amp; "), F.col("r_name"))).otherwise("a &#x2013; b & c;")
    cut = tx.entity_contexts(told)
    out = t(spark, d, "region").select("r_regionkey", F.explode(cut).alias("x")).select("r_regionkey", "x.entity", "x.context")
    return out.withColumn("context", F.regexp_replace("context", " & c;$", ""))


@case("""SELECT * FROM (VALUES (1, 'startdate,status', 'x'), (2, '', ''), (3, 'country,role', 'DE,FR,it''s = 1'), (4, 'note', 'a%')) x(id, axes, literals)""")
def statement_axes(spark, d):
    rows = [
        (1, "SELECT 1 WHERE p.status = 'x' AND startDate >= 1 AND id IN (1)"), (2, "SELECT id FROM t"),
        (3, "SELECT id FROM o WHERE country IN ('DE', 'FR') AND role <> 'it''s = 1'"), (4, "SELECT 1 FROM t WHERE projectID = 3 AND note NOT ILIKE 'a%' AND x IS NULL"),
    ]
    s = inline(spark, "id int, sql string", rows)
    quoted = F.transform(tx.quoted_literals(F.col("sql")), lambda v: F.replace(v, F.lit("''"), F.lit("'")))
    return s.select("id", F.array_join(tx.filter_axes(F.col("sql")), ",").alias("axes"), F.array_join(quoted, ",").alias("literals"))


# ---- chunks

_RAW_SENTENCES = r"""list_filter(string_split(regexp_replace(ps[i], '([.!?]["'')\]]?\s)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"""
_UNITS = f"""
p AS (SELECT doc_id, i, length(ps[i]) > 600 AS long, CASE WHEN length(ps[i]) > 600 THEN {_RAW_SENTENCES} ELSE [ps[i]] END AS us FROM (SELECT doc_id, {PARAGRAPHS} AS ps FROM documents) x, range(1, len(ps) + 1) r(i)),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, us[j] AS txt, long, j = 1 AS opens FROM p, range(1, len(us) + 1) r(j)),
r AS (SELECT doc_id, k, txt, long, 0 AS chunk FROM u WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN shut THEN new ELSE old || glue || new END, long, chunk + CAST(shut AS INT) FROM (
    SELECT u.doc_id, u.k, u.txt AS new, r.txt AS old, u.long, r.chunk, CASE WHEN u.long THEN '' ELSE chr(10) END AS glue,
           (u.long AND u.opens) OR u.long <> r.long OR length(r.txt) + (CASE WHEN u.long THEN 0 ELSE 1 END) + length(u.txt) > (CASE WHEN u.long THEN 600 ELSE 400 END) AS shut
    FROM r JOIN u ON u.doc_id = r.doc_id AND u.k = r.k + 1))
"""


@query(f"WITH RECURSIVE {_UNITS} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(max(length(txt)) AS BIGINT) AS n, md5(arg_max(txt, k)) AS digest FROM r GROUP BY 1, 2")
def structure_first_chunks(spark, d):
    c = t(spark, d, "documents").select("doc_id", F.posexplode(chunking.structure_first(F.col("text"), 400, 600)).alias("chunk", "txt"))
    return c.select("doc_id", big(F.col("chunk")).alias("chunk"), big(F.length("txt")).alias("n"), F.md5(F.col("txt").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, length(text) AS total, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, total, ls[i] AS line, CAST(i - 1 + coalesce(list_sum(list_transform(ls[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS o FROM l, range(1, len(ls) + 1) r(i)),
b AS (SELECT doc_id, total, o + length(line) - length(ltrim(line)) AS a, o + length(line) - length(ltrim(line)) + length(trim(line)) AS z FROM x WHERE trim(line) <> '')
SELECT doc_id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE (a // 400 + 1) * 400 < z AND (a // 400 + 1) * 400 < total) AS INT) AS split FROM b GROUP BY 1""")
def split_paragraph_share(spark, d):
    s = t(spark, d, "documents").select("doc_id", chunking.split_paragraphs(F.col("text"), 400).alias("x"))
    return s.select("doc_id", "x.n", "x.split").where("n > 0")


@query("SELECT doc_id AS project_id, section, count(*) AS n FROM (SELECT doc_id, 'objective' AS section FROM documents WHERE trim(coalesce(text, '')) <> '' UNION ALL SELECT doc_id, 'summary' FROM documents WHERE trim(coalesce(text, '')) <> '') GROUP BY 1, 2")
def cut_sections(spark, d):
    docs = t(spark, d, "documents")
    projects = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("acronym"), F.col("source").alias("title"), F.col("text").alias("objective"))
    reports = docs.select(F.col("doc_id").alias("project_id"), F.lit(None).cast("string").alias("teaser"), F.col("text").alias("summary"))
    return chunking.report_sections(projects, reports).groupBy("project_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, source, CAST(place AS INT) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS place FROM (
  SELECT doc_id, source, -ln((CAST('0x' || substr(md5('sample-1|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / n_chars AS k FROM documents WHERE n_chars > 0)) WHERE place <= 20""")
def weighted_sample(spark, d):
    """Twenty documents of each source, long ones more often."""
    return readers.stratified_sample(t(spark, d, "documents"), 20, "source", "doc_id", F.col("n_chars")).select("doc_id", "source", "place")


# ---- indexes and rankings


@query("""SELECT 'same rows' AS asked, count(*) = (SELECT count(*) FROM documents) AS fresh FROM documents
UNION ALL SELECT 'one language', count(*) FILTER (WHERE lang IS DISTINCT FROM 'en') = 0 FROM documents
UNION ALL SELECT 'edited', count(*) FILTER (WHERE coalesce(text, '') <> coalesce(replace(text, 'License', 'Licence'), '')) = 0 FROM documents
UNION ALL SELECT 'other order', count(*) = count(DISTINCT doc_id) FROM documents""")
def index_freshness(spark, d):
    """A stored index knows its table by ids and texts: fewer rows and edited ones make it stale, their order doesn't."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "text")
    index = lexicon.create(docs, "doc_id", F.col("text"), new_path(spark, "lexicon"))
    fresh = lambda df: lexicon.fresh(index, df, "doc_id", F.col("text"))
    edited = docs.withColumn("text", F.replace("text", F.lit("License"), F.lit("Licence")))
    rows = [("same rows", fresh(docs)), ("one language", fresh(docs.where("lang = 'en'"))), ("edited", fresh(edited)), ("other order", fresh(docs.orderBy(F.desc("doc_id"))))]
    return inline(spark, "asked string, fresh boolean", rows)


_NEAR = "SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.vec_id % 20 = 0"


@query(f"""WITH s AS ({_NEAR}), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
b AS (SELECT query_id, id, sc AS score, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM (SELECT query_id, id, round(score, 2) AS sc FROM s)),
l AS (SELECT query_id, min(score) AS last FROM b WHERE rank <= 10 GROUP BY 1)
SELECT b.query_id, count(*) FILTER (WHERE a.id IS NOT NULL OR b.score - last <= 0.002) AS common, bool_or(b.rank = 1 AND b.id = f.id) AS agree_first
FROM b JOIN l ON l.query_id = b.query_id LEFT JOIN a ON a.query_id = b.query_id AND a.id = b.id AND a.rank <= 10 JOIN a f ON f.query_id = b.query_id AND f.rank = 1 WHERE b.rank <= 10 GROUP BY 1""")
def ranking_agreement(spark, d):
    """Exact scores against scores of two decimals: how far two indexes' rankings agree."""
    ranked = lambda decimals: neighbours(spark, d, 10, decimals=decimals).select("query_id", F.col("vec_id").alias("id"), "score", "rank")
    return retrieval.overlap_within(ranked(6), ranked(2))


@query(f"""WITH {_LEGS}, u AS (SELECT 'lexical' AS c, * FROM lex WHERE rank <= 20 UNION ALL SELECT 'dense', * FROM den WHERE rank <= 20 UNION ALL SELECT 'hybrid', query_id, id, rank FROM fused WHERE rank <= 20 UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM ({_RERANKED}) WHERE rank <= 20),
p AS (SELECT query_id, id, min(rank) FILTER (WHERE c = 'lexical') AS lexical, min(rank) FILTER (WHERE c = 'dense') AS dense, min(rank) FILTER (WHERE c = 'hybrid') AS hybrid, min(rank) FILTER (WHERE c = 'hybrid_rerank') AS hybrid_rerank, min(rank) AS best_rank, CAST(count(*) AS INT) AS n_conditions FROM u GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, n_conditions DESC, id) AS INT) AS place FROM p""")
def pooled_conditions(spark, d):
    return retrieval.pooled(retrieval.conditions(*legs(spark, d), asked(spark, d), texts(spark, d), 20))


@query(f"""WITH {_LEGS}, one AS (SELECT min(item_id) AS q FROM benchmark)
SELECT 'lexical' AS retriever, id, rank FROM lex JOIN one ON query_id = q WHERE rank <= 5 UNION ALL SELECT 'dense', id, rank FROM den JOIN one ON query_id = q WHERE rank <= 5
UNION ALL SELECT 'hybrid', id, rank FROM fused JOIN one ON query_id = q WHERE rank <= 5 UNION ALL SELECT 'hybrid_rerank', id, rank FROM ({_RERANKED}) JOIN one ON query_id = q WHERE rank <= 5""")
def named_retrievers(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    question = t(spark, d, "benchmark").orderBy("item_id").select("text").head()[0]
    engine, out = Engine(spark, docs, embed=bag_vector, stemmed=False), None
    for name in retrieval.RETRIEVERS:
        r = engine.ranking(question, 5, name).select(F.lit(name).alias("retriever"), "id", "rank")
        out = r if out is None else out.unionByName(r)
    return out


# ---- near duplicates and collisions of a batch


@query(f"SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN false ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.34 END AS echo FROM (SELECT p_partkey, {topic('p_name')} AS a, {topic("p_name || ' ' || p_type")} AS b FROM part)")
def label_echo(spark, d):
    a, b = tx.topic_words(F.col("p_name")), tx.topic_words(F.concat_ws(" ", "p_name", "p_type"))
    return t(spark, d, "part").select("p_partkey", similarity.echoes_label(a, b).alias("echo"))


_BATCH = "SELECT item_id AS id, text, CAST(NULL AS BIGINT) AS twin_id FROM benchmark UNION ALL SELECT item_id + 10000, regexp_replace(text, '[^ ]+$', 'changed'), CASE WHEN item_id % 2 = 1 THEN item_id END FROM benchmark"
_FLAT = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(rf"""WITH b AS ({_BATCH}), s AS (SELECT id, twin_id, {topic('text')} AS w, list_distinct(list_transform(range(1, greatest(length(f) - 1, 1)), lambda i: substring(f, i, 3))) AS g FROM (SELECT *, {_FLAT} AS f FROM b)),
p AS (SELECT x.id AS a, y.id AS b, x.twin_id AS s, y.twin_id AS t, len(list_intersect(x.w, y.w)) / nullif(len(list_distinct(list_concat(x.w, y.w))), 0) AS wj, len(list_intersect(x.g, y.g)) / nullif(len(list_distinct(list_concat(x.g, y.g))), 0) AS gj FROM s x JOIN s y ON x.id < y.id)
SELECT a, b, CASE WHEN wj >= 0.5 THEN round(wj, 6) END AS token, CASE WHEN gj >= 0.45 THEN round(gj, 6) END AS trigram, NOT (coalesce(s = b, false) OR coalesce(t = a, false)) AS flagged FROM p WHERE wj >= 0.5 OR gj >= 0.45""")
def near_duplicate_flags(spark, d):
    b = t(spark, d, "benchmark")
    again = b.select((F.col("item_id") + 10000).alias("id"), F.regexp_replace("text", "[^ ]+$", "changed").alias("text"), F.when(F.col("item_id") % 2 == 1, F.col("item_id")).alias("twin_id"))
    batch = b.select(F.col("item_id").alias("id"), "text", F.lit(None).cast("bigint").alias("twin_id")).unionByName(again)
    n = similarity.near_duplicates(batch)
    return n.withColumns({"token": F.round("token", 6), "trigram": F.round("trigram", 6)})


_GOLDS = [("a", [1, 2, 3], "t1", ["country", "role"]), ("b", [3, 4], "t1", ["role"]), ("c", [9], None, ["country", "role"]), ("d", None, "t2", []), ("e", [4, 3], None, None)]
_HELD = [("old1", [2, 9]), ("old2", [77])]
_GOLDS_SQL = "(VALUES ('a', [1, 2, 3], 't1', ['country', 'role']), ('b', [3, 4], 't1', ['role']), ('c', [9], NULL, ['country', 'role']), ('d', NULL, 't2', []), ('e', [4, 3], NULL, NULL)) g(id, gold, twin_id, axes)"


def _golds(spark) -> DataFrame:
    return inline(spark, "id string, gold array<bigint>, twin_id string, axes array<string>", _GOLDS)


@case(f"""WITH m AS (SELECT id, unnest(gold) AS g FROM {_GOLDS_SQL}), h AS (SELECT id, unnest(gold) AS g FROM (VALUES ('old1', [2, 9]), ('old2', [77])) x(id, gold) UNION ALL SELECT * FROM m)
SELECT m.id, h.id AS other, array_to_string(list_sort(list(m.g)), ',') AS common FROM m JOIN h ON m.g = h.g AND m.id <> h.id GROUP BY 1, 2""")
def gold_overlap(spark, d):
    o = similarity.gold_overlap(_golds(spark), inline(spark, "id string, gold array<bigint>", _HELD))
    return o.select("id", "other", F.array_join(F.col("common").cast("array<string>"), ",").alias("common"))


@case(f"SELECT twin_id, string_agg(id, ',' ORDER BY id) AS ids FROM {_GOLDS_SQL} WHERE twin_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def twin_collision(spark, d):
    return similarity.twin_collision(_golds(spark)).withColumn("ids", F.array_join("ids", ","))


@case(f"SELECT array_to_string(axes, '+') AS axes, string_agg(id, ',' ORDER BY id) AS ids FROM {_GOLDS_SQL} WHERE len(axes) > 0 GROUP BY 1 HAVING count(*) > 1")
def axis_collision(spark, d):
    return similarity.axis_collision(_golds(spark)).withColumn("ids", F.array_join("ids", ","))


@query("SELECT lang AS label, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM documents) / 3")
def label_spread(spark, d):
    return similarity.spread(t(spark, d, "documents"), "lang")


@query("SELECT lang, wanted, coalesce(s, 0) AS stock, wanted - coalesce(s, 0) AS short FROM (VALUES ('en', 100), ('de', 100000), ('xx', 3)) w(lang, wanted) LEFT JOIN (SELECT lang AS l, count(*) AS s FROM documents GROUP BY 1) ON l = lang WHERE wanted > coalesce(s, 0)")
def supply_check(spark, d):
    return similarity.supply(inline(spark, "lang string, wanted bigint", [("en", 100), ("de", 100000), ("xx", 3)]), t(spark, d, "documents"), "lang")


@query("SELECT role AS value, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1 HAVING count(DISTINCT conv_id) > (SELECT count(DISTINCT conv_id) FROM conversations) / 3")
def wide_axes(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return similarity.wide_axes(c, "conv_id", "roles")


# ---- guard

_RUNS = [
    (1, "SELECT r_name FROM _runs -- all of them"), (2, "DROP TABLE _runs"), (3, "SELECT 1; SELECT 2"), (4, " ; "), (5, "WITH a AS (SELECT 1) DELETE FROM a"), (6, "SELECT * FROM no_such_table"),
    (7, "SELECT sum(a.id * b.id % 7) FROM range(3000000) a JOIN range(3000000) b ON a.id % 3 = b.id % 3"), (8, "SELECT 'drop; table' AS s /* ; */"), (9, "SELECT id FROM range(5000)"), (10, "SELECT r_name r_name FROM"),
]


@query("""SELECT * FROM (VALUES (1, '5 rows'), (2, 'GuardError: only SELECT may run, not DROP'), (3, 'GuardError: more than one statement'), (4, 'GuardError: empty statement'), (5, 'GuardError: DELETE may not be used'),
(6, 'AnalysisException'), (7, 'timed out'), (8, '1 rows'), (9, '1000 rows of more'), (10, 'ParseException')) x(id, verdict)""")
def guarded_runs(spark, d):
    t(spark, d, "region").createOrReplaceTempView("_runs")

    def verdict(sql: str) -> str:
        r = guard.run(spark, sql, timeout_s=3)
        if r.error is None:
            return f"{len(r.rows)} rows" + (" of more" if r.truncated else "")
        return r.error if r.error.startswith(("GuardError", "timed")) else r.error.partition(":")[0]

    return inline(spark, "id int, verdict string", [(i, verdict(s)) for i, s in _RUNS])


@case("""SELECT * FROM (VALUES (1, 'SELECT a FROM t LIMIT 7'), (2, 'SELECT a FROM t LIMIT 3'), (3, 'SELECT a FROM (SELECT b FROM t LIMIT 3) LIMIT 7'), (4, 'SELECT ''LIMIT 2'' FROM t LIMIT 7')) x(id, limited)""")
def statement_limits(spark, d):
    rows = [(1, "SELECT a FROM t"), (2, "SELECT a FROM t LIMIT 3"), (3, "SELECT a FROM (SELECT b FROM t LIMIT 3)"), (4, "SELECT 'LIMIT 2' FROM t")]
    return inline(spark, "id int, limited string", [(i, guard.with_limit(s, 7)) for i, s in rows])


@case("""SELECT * FROM (VALUES (1, 'SELECT 1 ' || chr(10) || 'FROM t'), (2, 'SELECT ''--no'' FROM t'), (3, 'SELECT 1  + 2'), (4, 'SELECT "a--b" FROM t  ')) x(id, bare)""")
def comment_stripping(spark, d):
    rows = [(1, "SELECT 1 -- one\nFROM t"), (2, "SELECT '--no' FROM t"), (3, "SELECT 1 /* x */+ 2"), (4, 'SELECT "a--b" FROM t /* open')]
    return inline(spark, "id int, bare string", [(i, guard.without_comments(s)) for i, s in rows])


@case("""SELECT * FROM (VALUES (1, 'the weather', NULL), (2, 'this information', NULL), (3, NULL, 'SELECT 1'), (4, 'prices', NULL), (5, NULL, 'SELECT 2')) x(id, missing, statement)""")
def writer_replies(spark, d):
    rows = [(1, "NO_SUCH_DATA: the weather."), (2, "no_such_data:"), (3, "so:\n```sql\nSELECT 1\n```"), (4, "```\nNO_SUCH_DATA: prices\n```"), (5, " SELECT 2 ")]
    return inline(spark, "id int, missing string, statement string", [(i, m := guard.no_such_data(r), None if m else guard.without_fences(r)) for i, r in rows])


@case("SELECT * FROM (VALUES ('mended', true, 3, '', ''), ('at once', false, 3, '', ''), ('never', true, 0, 'AnalysisException', ''), ('unrecorded', false, 0, '', 'it')) x(question, retried, n_rows, error, missing)")
def retried_questions(spark, d):
    def write(question: str, error: str | None) -> str:
        if question == "unrecorded":
            return "NO_SUCH_DATA: it"
        return "SELECT id FROM range(3)" if question == "at once" or (question == "mended" and error) else "SELECT nope FROM range(3)"

    out = [(q, guard.ask(spark, q, write)) for q in ("mended", "at once", "never", "unrecorded")]
    return inline(spark, "question string, retried boolean, n_rows int, error string, missing string", [(q, r.retried, len(r.rows), (r.error or "").partition(":")[0], r.no_such_data or "") for q, r in out])


@case("""SELECT * FROM (VALUES (1, ''), (2, 'null test of a comparison'), (3, 'constant comparison'), (4, 'constant comparison'), (5, 'filter on note'), (6, ''), (7, 'null test of a comparison; filter on note'), (8, '')) x(id, problems)""")
def lint_cases(spark, d):
    where = ["true = flag AND a IS NOT NULL", "t.a = 'x' IS NULL", "1 = 1", "a = 2 OR TRUE", "note NOT ILIKE '%x%'", "a = 'note = 1'", "(note LIKE 'x%') IS NOT NULL", "a BETWEEN 1 AND 2 AND b = 1"]
    return inline(spark, "id int, problems string", [(i + 1, "; ".join(guard.lint(f"SELECT 1 FROM t WHERE {w}", ["note"]))) for i, w in enumerate(where)])


@query("SELECT * FROM (VALUES ('o_orderstatus', 'IN', 'Y'), ('o_orderstatus', 'IN', 'Z'), ('o_orderpriority', '=', 'none'))  x(\"column\", op, value)")
def dead_values(spark, d):
    sql = "SELECT 1 FROM orders WHERE o_orderstatus IN ('F', 'X') AND o_orderstatus IN ('Y', 'Z') AND o_orderpriority = 'none' AND NOT o_orderpriority = 'never' AND o_orderpriority LIKE '1%'"
    counts = guard.live_values(t(spark, d, "orders"), guard.literals(sql, ["o_orderstatus", "o_orderpriority"])).collect()
    return inline(spark, "column string, op string, value string", guard.dead_literals([tuple(r) for r in counts]))


_ALL = "The filter could not be applied; results are of the whole corpus."


@query(f"""SELECT * FROM (VALUES ('ok', 'ok', 'Results are within the complete set of 1 records.', true), ('no constraints', 'ok', 'No constraints; results are of the whole corpus.', false), ('zero', 'zero_match', 'No record meets all conditions; each of them alone is met.', false),
('dead value', 'value_not_found', '{_ALL}', false), ('mended value', 'ok', 'Results are within the complete set of 1 records.', true), ('banned after that', 'value_not_found', '{_ALL}', false),
('unproven', 'unproven_zero', '{_ALL}', false), ('no statement', 'sql_failed', '{_ALL}', false), ('unknown column', 'sql_failed', '{_ALL}', false), ('constant', 'sql_failed', '{_ALL}', false)) x(asked, status, note, bounded)""")
def scoped_statuses(spark, d):
    """Every way that a filtered search can end."""
    t(spark, d, "region").createOrReplaceTempView("_scoped_regions")
    where = {
        "ok": ["r_name = 'ASIA'"], "zero": ["r_name = 'ASIA' AND r_regionkey = 0"], "dead value": ["r_name = 'ATLANTIS'"], "mended value": ["r_name = 'ATLANTIS'", "r_name = 'ASIA'"],
        "banned after that": ["r_name = 'ATLANTIS'", "r_name = 'ASIA' AND r_comment LIKE '%x%'"], "unproven": ["r_name = 'ASIA' AND r_regionkey = 99"], "unknown column": ["nope = 1"], "constant": ["1 = 1"],
    }

    def end(name: str) -> tuple:
        asked_before = []

        def write(constraints: list[str], hint: str | None) -> str:
            asked_before.append(hint)
            if name == "no statement":
                return "DROP TABLE x"
            tries = where[name]
            return f"SELECT r_regionkey AS id FROM _scoped_regions WHERE {tries[min(len(asked_before), len(tries)) - 1]}"

        seen = []
        search = lambda ids: (seen.append(ids is not None), spark.range(1))[1]
        r = scoped.retrieve(spark, None if name == "no constraints" else ["c"], write, search, {"r_name": "_scoped_regions"}, banned=["r_comment"])
        return name, r.status, r.note, any(seen)

    return inline(spark, "asked string, status string, note string, bounded boolean", [end(n) for n in [*where, "no statement", "no constraints"]])


@query("SELECT item_id AS answer_id, 'As [DOC, ' || item_id || '] says' || CASE WHEN item_id % 3 <> 0 THEN ', and more.' ELSE '.' END AS text, CASE WHEN item_id % 3 <> 0 THEN '[X1, ' || (item_id + 1000) || ']' ELSE '' END AS removed FROM benchmark")
def citation_strip(spark, d):
    b, key = t(spark, d, "benchmark"), F.col("item_id").cast("string")
    told = F.concat(F.lit("As [DOC, "), key, F.lit("] says"), F.when(F.col("item_id") % 3 != 0, F.concat(F.lit(", and more [X1, "), (F.col("item_id") + 1000).cast("string"), F.lit("]."))).otherwise("."))
    clean = scoped.strip_citations(b.select(F.col("item_id").alias("answer_id"), told.alias("text")), b.select(F.col("item_id").alias("answer_id"), F.array("item_id").alias("ids")))
    return clean.select("answer_id", "text", F.array_join("removed", "").alias("removed"))


# ---- comparison and verification


@query("""SELECT * FROM (VALUES ('same', true, 'match'), ('other order', true, 'match'), ('fewer', false, 'rows differ'), ('none', false, 'no-sql'), ('no gold', NULL, 'no gold result'), ('by name', true, 'match'), ('as is', true, 'match'), ('unmatched', false, 'columns_unmatched'), ('bad gold', NULL, 'gold lacks the answer''s columns')) x(given, passed, reason)""")
def scored_answers(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    turned = n.select("n_name", F.col("n_nationkey").cast("double").alias("n_nationkey"))
    names = ["n_name"]
    cases = {
        "same": (n, n, None), "other order": (n, turned, None), "fewer": (n, n.where("n_nationkey > 3"), None), "none": (n, None, None), "no gold": (None, n, None), "by name": (n, turned, names),
        "as is": (n, n.select(F.col("n_name").alias("x")), names), "unmatched": (n, turned.select(F.col("n_name").alias("x"), "n_nationkey"), names), "bad gold": (n.select("n_nationkey"), n, names),
    }
    return inline(spark, "given string, passed boolean, reason string", [(k, *compare.score(*v)) for k, v in cases.items()])


@query("""SELECT * FROM (VALUES ('holds', 'PASS', ''), ('other number', 'FAIL', 'not reproduced: 26'), ('empty', 'PASS', ''), ('not empty', 'FAIL', '5 rows where none were claimed'), ('nothing', 'FAIL', 'no rows'), ('zero count', 'PASS', '')) x(owner, status, detail)""")
def evidence_checks(spark, d):
    for n in ("nation", "region"):
        t(spark, d, n).createOrReplaceTempView(f"_evidence_{n}")
    count = "SELECT count(*) AS n FROM _evidence_nation"
    claims = [
        ("holds", count, "There are 25 nations", False), ("other number", count, "There are 26 nations", False), ("empty", "SELECT * FROM _evidence_region WHERE r_regionkey > 99", "", True),
        ("not empty", "SELECT r_name FROM _evidence_region", "", True), ("nothing", "SELECT r_name FROM _evidence_region WHERE r_regionkey > 99", "some", False), ("zero count", f"{count} WHERE n_nationkey > 99", "", True),
    ]
    return verify.verify(spark, [dict(zip(("owner", "sql", "claim", "expect_empty"), c, strict=True)) for c in claims]).drop("name")


@case("""SELECT * FROM (VALUES ('good', 'EXIST', 'PASS', ''), ('good', 'TEXT', 'PASS', ''), ('good', 'BUCKET', 'PASS', ''), ('good', 'READ-FIRST', 'PASS', ''), ('good', 'INDEPENDENT', 'PASS', ''), ('good', 'LABEL-ECHO', 'PASS', ''),
('bad', 'EXIST', 'FAIL', '9'), ('bad', 'TEXT', 'FAIL', '3'), ('bad', 'BUCKET', 'FAIL', '3,9'), ('bad', 'READ-FIRST', 'FAIL', '1'), ('bad', 'INDEPENDENT', 'FAIL', ''), ('bad', 'LABEL-ECHO', 'FAIL', '1.0')) x(owner, name, status, detail)""")
def map_entries(spark, d):
    entries = [("good", "physics / optics", "lasers and lenses", [1, 2], [1, 2, 4], [4]), ("bad", "physics / optics", "physics, optics", [1], [1, 3, 9], [1])]
    e = inline(spark, "owner string, bucket string, about string, read_first array<bigint>, read array<bigint>, used array<bigint>", entries)
    corpus = inline(spark, "id bigint, has_text boolean", [(1, True), (2, True), (3, False), (4, True)])
    buckets = inline(spark, "id bigint, bucket string", [(1, "physics / optics"), (2, "physics / optics"), (4, "physics / optics"), (3, "other / x")])
    return verify.map_entry(e, corpus, buckets)


@query("""SELECT * FROM (VALUES ('GOLD-SQL', 'PASS'), ('ANSWER-COLUMNS', 'FAIL'), ('GOLD-TEXT', 'PASS'), ('SURVIVORS', 'PASS'), ('GOLD-SURVIVES', 'FAIL'), ('WINDOW', 'PASS'), ('LEVEL', 'PASS'), ('TWIN-EXISTS', 'PASS'), ('TWIN-LIVE', 'PASS'), ('SCHEMA-DOCS', 'FAIL')) x(name, status)""")
def precheck_record(spark, d):
    n = t(spark, d, "nation")
    n.createOrReplaceTempView("_precheck_nations")
    record = {
        "question_id": "q1", "expected_route": "hybrid", "level": "L2", "subtype": "filter-compare", "gold_sql": "SELECT n_name FROM _precheck_nations", "answer_columns": ["n_name", "missing"], "gold_project_ids": [1, 2, 99],
        "filter_evidence": {"filter_sql": "SELECT n_nationkey AS id FROM _precheck_nations WHERE n_nationkey BETWEEN 1 AND 5", "survivor_ids": [1, 2, 3, 4, 5], "schema_docs_hash": "old"}, "twin_id": "q2",
    }
    bank = inline(spark, "question_id string, expected_route string, level string, gold_sql string, gold_project_ids array<bigint>", [("q2", "sql", "L1", "SELECT 1 FROM _precheck_nations", None)])
    corpus = n.select(F.col("n_nationkey").alias("id"), F.lit(True).alias("has_text")).unionByName(inline(spark, "id bigint, has_text boolean", [(99, True)]))
    checks = verify.precheck(spark, record, bank, corpus, "new")
    return inline(spark, "name string, status string", [(c.name, c.status) for c in checks])


@query("SELECT * FROM (VALUES ('no rows', true), ('count of none', true), ('decimal sum', true), ('truth value', false), ('null', false), ('two rows', false), ('text', false)) x(given, empty)")
def empty_results(spark, d):
    t(spark, d, "region").createOrReplaceTempView("_empty_regions")
    cases = {
        "no rows": "SELECT r_name FROM _empty_regions WHERE r_regionkey > 99", "count of none": "SELECT count(*) FROM _empty_regions WHERE r_regionkey > 99", "decimal sum": "SELECT sum(CAST(0 AS DECIMAL(18,2))) FROM _empty_regions",
        "truth value": "SELECT false", "null": "SELECT sum(r_regionkey) FROM _empty_regions WHERE r_regionkey > 99", "two rows": "SELECT 0 UNION ALL SELECT 0", "text": "SELECT '0'",
    }
    return inline(spark, "given string, empty boolean", [(k, compare.is_empty_result([tuple(r) for r in spark.sql(s).collect()])) for k, s in cases.items()])


# ---- quality


@query("""SELECT 'all sources parsed' AS name, CAST(count(*) AS VARCHAR) AS observed, true AS ok FROM documents UNION ALL SELECT 'a report for each summary row', CAST(count(*) AS VARCHAR), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'project exists', CAST(count(*) AS VARCHAR), count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'id begins with its project', CAST(count(*) FILTER (WHERE lang = 'de') AS VARCHAR), count(*) FILTER (WHERE lang = 'de') = 0 FROM documents
UNION ALL SELECT 'text present', CAST(count(*) FILTER (WHERE coalesce(length(text), 0) <= 100) AS VARCHAR), count(*) FILTER (WHERE coalesce(length(text), 0) <= 100) < count(*) * 0.02 FROM documents""")
def report_load_checks(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    name = F.concat(F.when(F.col("lang") == "de", F.lit("x")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit("_PS"))
    reports = docs.select(F.col("doc_id").alias("rcn"), name.alias("id"), F.col("doc_id").alias("project_id"), "text")
    return quality.report_load(reports, docs.count(), labels.select(F.col("doc_id").alias("rcn")), labels.select(F.col("doc_id").alias("id")))


@query("""SELECT 'one first line' AS name, CAST(count(*) AS VARCHAR) AS observed, count(*) = 0 AS ok FROM (SELECT o_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber = 1) <> 1)
UNION ALL SELECT 'one last line', CAST(count(*) AS VARCHAR), count(*) = 0 FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber = 7) <> 1)""")
def exactly_one_rule(spark, d):
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    return quality.Suite().exactly_one("one first line", li, "l_orderkey", F.col("l_linenumber") == 1, o, "o_orderkey").exactly_one("one last line", li, "l_orderkey", F.col("l_linenumber") == 7).result()


@query("""SELECT 'nation: columns' AS name, '' AS observed, true AS ok UNION ALL SELECT 'nation: rows', CAST(count(*) AS VARCHAR), count(*) = 25 FROM nation UNION ALL SELECT 'orders: columns', 'o_extra', false
UNION ALL SELECT 'orders.o_orderstatus: values', 'X', false UNION ALL SELECT 'orders.o_orderdate: nulls', CAST(count(*) - count(o_orderdate) AS VARCHAR), count(*) = count(o_orderdate) FROM orders
UNION ALL SELECT 'orders.o_totalprice: range', CAST(count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 200000) AS VARCHAR), count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 200000) = 0 FROM orders""")
def schema_regression(spark, d):
    n, o = t(spark, d, "nation"), t(spark, d, "orders")
    documented = {
        "nation": {"columns": n.columns, "rows": 25},
        "orders": {"columns": [*o.columns, "o_extra"], "values": {"o_orderstatus": ["F", "O", "P", "X"]}, "nulls": {"o_orderdate": 0}, "range": {"o_totalprice": (1000, 200000)}},
    }
    return quality.regression({"nation": n, "orders": o}, documented)


@query("SELECT * FROM (VALUES ('region', 'undocumented column r_name'), ('region', 'missing column r_code'), ('none', 'missing column x')) x(\"table\", problem)")
def schema_columns(spark, d):
    r = t(spark, d, "region")
    actual = inline(spark, "table string, column string", [("region", c) for c in ("r_regionkey", "r_name")])
    return quality.schema_check(actual, {"region": [r.columns[0], "r_code"], "none": ["x"]})


# ---- taxonomy, journals, banks


@query(f"""WITH p AS ({_PATHS_SQL}) SELECT 'branch' AS block, split_part(path, '/', 1) AS key, count(DISTINCT c_custkey) AS n FROM p GROUP BY 2
UNION ALL SELECT 'scheme', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2 UNION ALL SELECT 'no scheme', '', count(*) FROM orders WHERE o_orderpriority IS NULL
UNION ALL SELECT 'with text', '', count(DISTINCT doc_id) FROM labels""")
def orientation_blocks(spark, d):
    return records.orientation_blocks(paths(spark, d), "c_custkey", t(spark, d, "orders"), "o_orderpriority", t(spark, d, "labels"), "doc_id")


_SLOTS = [
    ("s1", "ACCEPTED", 0, [("1", "FIX"), ("2", "ACCEPT")], [("WORDING", "HIGH", "UPHELD: yes"), ("OTHER:x", "LOW", None)]), ("s2", "ACCEPTED", 2, [("1", "ACCEPT")], [("GOLD", "MID", "DISMISSED")]),
    ("s3", "ABANDONED", 1, [("1", "ABANDON")], [("OTHER:y", "HIGH", None), (None, "MID", "RECORDED")]), ("s4", "DRAFT", None, None, None),
]


@case("""SELECT metric, key, CAST(n AS BIGINT) AS n FROM (VALUES ('status', 'ACCEPTED', 2), ('status', 'ABANDONED', 1), ('status', 'DRAFT', 1), ('candidates tried', '', 7), ('rounds', '2', 1), ('rounds', '1', 2), ('rounds', '0', 1),
('disposition', 'FIX', 1), ('disposition', 'ACCEPT', 2), ('disposition', 'ABANDON', 1), ('severity', 'HIGH', 2), ('severity', 'MID', 2), ('severity', 'LOW', 1), ('class', 'WORDING', 1), ('class', 'GOLD', 1), ('class', 'OTHER:*', 2), ('class', '?', 1),
('ruling', 'HIGH/UPHELD', 1), ('ruling', 'MID/DISMISSED', 1), ('ruling', 'HIGH/unadjudicated', 1), ('ruling', 'MID/RECORDED', 1), ('accepted with an upheld finding', '', 1), ('accepted with a fix', '', 1)) x(metric, key, n)""")
def journal_summary(spark, d):
    schema = "slot string, status string, candidate_index int, judge_decisions array<struct<round: string, disposition: string>>, findings array<struct<class: string, severity: string, ruling: string>>"
    return records.journal_summary(inline(spark, schema, _SLOTS))


_SAY = "slot string, n int, judge_decisions array<struct<round: int, disposition: string, targets: array<string>, rationale: string>>, findings array<struct<class: string, severity: string, claim: string, note: string>>"


@case("SELECT * FROM (VALUES ('s1', '1:FIX,2:ACCEPT', 'A:new,B:b'), ('s2', '1:FIX,9:ACCEPT', '')) x(slot, decisions, findings)")
def journal_fold(spark, d):
    """Decisions of a later line that go on from the earlier ones replace them, others are appended; findings keep the last."""
    lines = [
        ("s1", 1, [(1, "FIX", None, "a")], [("A", "HIGH", "c", "old")]), ("s1", 2, [(1, "FIX", None, "a"), (2, "ACCEPT", None, "b")], [("A", "HIGH", "c", "new"), ("B", "LOW", "c", "b")]),
        ("s2", 1, [(1, "FIX", None, "a")], None), ("s2", 2, [(9, "ACCEPT", None, "b")], []),
    ]
    f = records.folded_slots(inline(spark, _SAY, lines), "slot", "n")
    told = F.transform("decisions", lambda x: F.concat_ws(":", x["round"].cast("string"), x["disposition"]))
    found = F.transform("findings", lambda x: F.concat_ws(":", x["class"], x["note"]))
    return f.select("slot", F.array_join(told, ",").alias("decisions"), F.array_join(found, ",").alias("findings"))


@query("""SELECT 'tool' AS metric, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'with failures', event_type, count(*) FROM events WHERE event_type IN ('click', 'error') GROUP BY 2
UNION ALL SELECT 'errors', '', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'active days', '', count(DISTINCT CAST(ts AS DATE)) FROM events""")
def call_summary(spark, d):
    e = t(spark, d, "events")
    return records.call_summary(e.select(F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").isin("click", "error").cast("int").alias("failures"), "ts"))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS i FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT DISTINCT o_custkey AS i FROM orders WHERE o_orderstatus = 'P'), a AS (SELECT DISTINCT o_custkey AS i FROM orders WHERE o_orderpriority LIKE '1%')
SELECT 'bank' AS metric, (SELECT count(*) FROM b) AS n UNION ALL SELECT 'trimmed', (SELECT count(*) FROM t) UNION ALL SELECT 'either', (SELECT count(*) FROM (SELECT i FROM b UNION SELECT i FROM t)) UNION ALL SELECT 'bank from batches', (SELECT count(*) FROM b WHERE i IN (SELECT i FROM a))
UNION ALL SELECT 'bank otherwise', (SELECT count(*) FROM b WHERE i NOT IN (SELECT i FROM a)) UNION ALL SELECT 'trimmed from batches', (SELECT count(*) FROM t WHERE i IN (SELECT i FROM a))""")
def bank_summary(spark, d):
    o = t(spark, d, "orders")
    return records.bank_summary(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), o.where("o_orderpriority LIKE '1%'"), "o_custkey")


@case("SELECT * FROM (VALUES ('bank', 'q1', ''), ('bank', 'q3', ''), ('archive', 'q2', 'stale')) x(place, question_id, reason)")
def bank_versions(spark, d):
    """Promoted, archived and promoted again: each step is one new version."""
    row = lambda q, twin=None: (q, f"text of {q}", "sql", "L1", None, "SELECT 1", None, None, twin, None)
    bank, old = new_path(spark, "bank"), new_path(spark, "archive")
    bankfile.promote(spark, bank, inline(spark, _RECORD, [row("q1"), row("q2", "q1")]))
    bankfile.archive(spark, bank, old, ["q2"], "stale")
    bankfile.promote(spark, bank, inline(spark, _RECORD, [row("q3")]))
    show = lambda path, name, reason: bankfile.current(spark, path).select(F.lit(name).alias("place"), "question_id", reason.alias("reason"))
    return show(bank, "bank", F.lit("")).unionByName(show(old, "archive", F.col("reason")))


@case("""SELECT * FROM (VALUES ('r1', 'hybrid without filter evidence'), ('r1', 'gold count outside the subtype'), ('r2', 'level unlike the gold count'), ('r4', 'adversarial with gold'), ('r5', 'survivors outside the subtype''s window'), ('Bad id', 'bad id'), ('r6', 'filter evidence on another route'), ('r6', 'repeated survivors'),
('r8', 'repeated answer columns'), ('r8', 'answer columns without gold sql'), ('r8', 'no gold sql'), ('r9', 'unknown subtype')) x(question_id, violation)""")
def bank_rules(spark, d):
    schema = _RECORD + ", answer_columns array<string>, override_reason string"
    row = lambda q, route, level="L1", subtype=None, sql=None, gold=None, seen=None, proof=None, answer=None, why=None: (q, f"text of {q}", route, level, subtype, sql, gold, seen, None, proof, answer, why)
    rows = [
        row("r1", "hybrid", "L2", "filter-read", gold=[1, 2]), row("r2", "vector", "L3", gold=[1]), row("r3", "vector", "L3", gold=[1], why="reviewed"), row("r4", "adversarial", sql="SELECT 1", proof=["x"]),
        row("r5", "hybrid", "L2", "filter-compare", gold=[1, 2], seen=(list(range(1, 31)),)), row("Bad id", "sql", sql="SELECT 1"), row("r6", "sql", sql="SELECT 1", seen=([1, 1],)),
        row("r7", "hybrid", "L2", "filter-compare", gold=[1, 2], seen=(list(range(1, 31)),), why="reviewed"), row("r8", "sql", answer=["A", "a"]), row("r9", "hybrid", "L2", "filter-else", gold=[1, 2], seen=([1, 2, 3],)),
    ]
    return records.violations(inline(spark, schema, rows))


# ---- runs of a bank

_BANK = "question_id string, text string, expected_route string, level string, gold_sql string, answer_columns array<string>, gold_project_ids array<bigint>"


@query("""SELECT * FROM (VALUES ('force-vector', 'q1', 'vector', false, 'no-sql'), ('force-vector', 'q2', 'vector', false, 'no-sql'), ('force-vector', 'q3', 'vector', true, ''), ('force-vector', 'q4', 'vector', NULL, 'nothing to score by'),
('router', 'q1', 'sql', true, 'match'), ('router', 'q2', 'sql', false, 'rows differ'), ('router', 'q3', 'vector', true, ''), ('router', 'q4', 'sql', NULL, 'nothing to score by')) x(condition, question_id, mode, passed, reason)""")
def bank_run(spark, d):
    """Four questions under two conditions, stopped after the first and resumed."""
    t(spark, d, "nation").createOrReplaceTempView("_run_nations")
    docs = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("the nation of "), F.col("n_name")).alias("text"))
    first = docs.orderBy("id").head()
    statement = {"q1": "SELECT n_name FROM _run_nations WHERE n_regionkey = 1", "q2": "SELECT n_name FROM _run_nations WHERE n_regionkey = 2", "q4": "SELECT 1 AS x"}
    write = lambda question, error: statement[question[:2]]
    engine = Engine(spark, docs, write_sql=write, facts=lambda q: (q[:2] == "q3", []), stemmed=False)
    bank = [
        ("q1", "q1 of region 1", "sql", "L1", "SELECT n_name, n_nationkey FROM _run_nations WHERE n_regionkey = 1", ["n_name"], None), ("q2", "q2 of region 1", "sql", "L2", "SELECT n_name FROM _run_nations WHERE n_regionkey = 1", ["n_name"], None),
        ("q3", f"q3 {first['text']}", "vector", "L1", None, None, [first["id"]]), ("q4", "q4", "sql", "L1", None, None, None),
    ]
    path, frame = new_path(spark, "run"), inline(spark, _BANK, bank)
    runs.run_bank(engine, frame.where("question_id = 'q1'"), path, "r1", ["router"], 5)
    done = runs.run_bank(engine, frame, path, "r1", ["router", "force-vector"], 5)
    return done.select("condition", "question_id", "mode", "passed", "reason")


@query(f"""WITH {_LEGS}, gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), ng AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
c AS (SELECT 'lexical' AS condition, query_id, id, rank FROM lex UNION ALL SELECT 'hybrid', query_id, id, rank FROM fused WHERE rank <= 20),
m AS (SELECT x.condition, k, ng.query_id, n, count(c.rank) AS f, min(c.rank) AS first, coalesce(sum(1 / log2(c.rank + 1)), 0) AS dcg FROM (VALUES ('lexical'), ('hybrid')) x(condition), (VALUES (5), (20)) y(k), ng JOIN gold g ON g.query_id = ng.query_id
      LEFT JOIN c ON c.condition = x.condition AND c.query_id = ng.query_id AND c.id = g.id AND c.rank <= k GROUP BY 1, 2, 3, 4)
SELECT condition, query_id, k, CAST(f > 0 AS INT) AS hit, round(f / n, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM m""")
def retrieval_run(spark, d):
    lex, den = legs(spark, d)
    rankings = {"lexical": lex, "hybrid": retrieval.hybrid(lex, den, k=20)}
    return runs.run_retrieval(rankings, holding(spark, d), (5, 20))
