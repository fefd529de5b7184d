import json
import math

import pytest
from pyspark.sql import functions as F

from lakelens.functions import text as tx
from lakelens.functions import vector
from lakelens.functions.stem import porter
from lakelens.operators import chunking, compare, guard, quality, records, retrieval, scoped, similarity
from lakelens.sources import readers


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


# ---- functions


def test_porter_on_published_examples():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust defensible defens replacement replac adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll".split()
    for word, stem in zip(pairs[::2], pairs[1::2], strict=True):
        assert porter(word) == stem, word


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, tx.topic_words(lit("The graphene, GRAPHENE at a lab of x1y"))) == ["graphene", "lab", "x1y"]
    assert one(spark, tx.trigrams(lit(" Ab  c"))) == ["ab ", "b c"]
    assert one(spark, tx.trigrams(lit("ab"))) == []
    assert one(spark, tx.jaccard(F.array(lit("a")), F.expr("cast(array() as array<string>)"))) == 0.0
    assert one(spark, tx.sentences(lit('One. "Two!" Three? four'))) == ["One.", '"Two!"', "Three?", "four"]
    assert one(spark, tx.paragraphs(lit("a\n \n b "))) == ["a", "b"]
    assert one(spark, tx.acronyms(lit("The ESA-X1 and SME with EUR, ÉABC"))) == ["ESA-X1"]
    assert one(spark, tx.numbers(lit("1,234.5 of 7"))) == ["1234.5", "7"]
    assert one(spark, tx.filter_axes(lit("SELECT 1 WHERE p.status = 'x' AND startDate >= 1 AND id IN (1)"))) == ["startdate", "status"]
    assert one(spark, tx.html_entities(lit("a &amp; b &#39; &nope"))) == ["&amp;", "&#39;"]
    assert one(spark, tx.has_text(lit(" "), lit(None))) is False
    assert one(spark, tx.windows(lit("abcdefgh"), 4, 1)) == ["abcd", "defg", "gh"]
    assert len(one(spark, tx.fingerprint(lit("x")))) == 12


def test_vector_functions(spark):
    a = F.array(*[F.lit(x) for x in (3.0, 4.0)])
    assert one(spark, vector.norm(a)) == 5.0
    assert one(spark, vector.normalised(a)) == [0.6, 0.8]
    assert one(spark, vector.problems(a, 2)) == ["norm"]
    assert one(spark, vector.problems(F.array(F.lit(float("nan"))), 2)) == ["dimension", "not finite"]


# ---- sources


def test_delimited_defects(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿"id";"cost";"note"\n"1";"1,50";"say ""hi"""\n"2";;"b"\n;"3";\n"4";"x";"c";"d"\nbroken\n', encoding="utf-8")
    good, bad = readers.read_delimited(spark, str(tmp_path / "x.csv"))
    assert sorted(tuple(r) for r in good.collect()) == [("", "3", ""), ("1", "1,50", 'say "hi"'), ("2", "", "b")]
    assert {r["problem"] for r in bad.collect()} == {"4 fields", "not quoted"}
    mapping = {"id": ("id", "bigint"), "cost": ("cost", "decimal(18,2)"), "note": ("note", "string")}
    typed = {r["id"]: r["cost"] for r in readers.typed_table(good, mapping).collect()}
    assert str(typed[1]) == "1.50" and typed[2] is None
    with pytest.raises(ValueError, match="unknown"):
        readers.typed_table(good, {"id": ("id", "bigint")})


def test_xml_jsonl_markdown(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<all><result><id>1</id><title>a</title></result><result><id>x</id></result></all>")
    rows = readers.read_xml(spark, str(tmp_path / "r.xml"), "result", "id bigint, title string").collect()
    assert [(r["id"], r["title"]) for r in rows][0] == (1, "a") and rows[1]["id"] is None
    (tmp_path / "j" / "archive").mkdir(parents=True)
    (tmp_path / "j" / "a.jsonl").write_text('{"k": 1}\nbad\n')
    (tmp_path / "j" / "archive" / "b.jsonl").write_text('{"k": 2}\n')
    with pytest.raises(ValueError, match="bad"):
        readers.read_jsonl(spark, str(tmp_path / "j"), "k bigint")
    assert [r["k"] for r in readers.read_jsonl(spark, str(tmp_path / "j"), "k bigint", strict=False, exclude="/archive/").collect()] == [1]
    md = F.lit("intro\n## A\n| x | y |\n|---|---|\n| 1 | 2 |\n## B\n- id: q1\n text\n- id: q2\n more")
    assert [s["title"] for s in one(spark, readers.markdown_sections(md))] == ["A", "B"]
    assert one(spark, readers.markdown_rows(md)) == [["x", "y"], ["1", "2"]]
    assert [b["id"] for b in one(spark, readers.id_blocks(md))] == ["q1", "q2"]


def test_index_and_journal(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    readers.save_index(v, str(tmp_path / "i"), "m", 2)
    assert readers.load_index(spark, str(tmp_path / "i"), "m", 2).count() == 1
    with pytest.raises(ValueError):
        readers.load_index(spark, str(tmp_path / "i"), "other", 2)
    readers.append_journal(spark.createDataFrame([(1, "a")], "k int, s string"), str(tmp_path / "j"))
    readers.append_journal(spark.createDataFrame([(1, "b")], "k int, s string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert readers.hash_sample(spark.range(50), 7, "id").count() == 7
    assert sorted(r["id"] for r in readers.by_ids(spark.range(50), "id", [3, 7, 99]).collect()) == [3, 7]


def test_quality(spark):
    df = spark.createDataFrame([(1, None), (1, "a")], "k int, s string")
    assert {r["column"]: r["n_null"] for r in quality.null_profile(df).collect()} == {"k": 0, "s": 1}
    got = {r["name"]: r["ok"] for r in quality.Suite().unique("u", df, "k").subset("s", df, "s", ["a"]).share("h", df, F.col("s").isNotNull(), 0.8).result().collect()}
    assert got == {"u": False, "s": True, "h": False}


# ---- retrieval


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana"), (3, "")], "id bigint, text string")
    terms, lengths = retrieval.postings(docs, "id", F.col("text"))
    q = spark.createDataFrame([(9, "Apple banana"), (8, "nothing")], "query_id bigint, query string")
    got = [tuple(r) for r in retrieval.bm25(terms, lengths, q, 5).select("query_id", "doc_id", "score", "rank").orderBy("rank").collect()]

    def part(tf, df, dl):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (4 / 3)))

    assert got == [(9, 1, round(part(2, 1, 3) + part(1, 2, 3), 6), 1), (9, 2, round(part(1, 2, 1), 6), 2)]
    none = spark.createDataFrame([], "doc_id bigint")
    assert retrieval.bm25(terms, lengths, q, 5, allowed=none).count() == 0


def test_dense_in_blocks_of_queries(spark, monkeypatch):
    import random

    rng = random.Random(5)
    vecs = {i: [rng.randint(-3, 3) / 4 for _ in range(3)] for i in range(60)}
    v = spark.createDataFrame(list(vecs.items()), "vec_id bigint, embedding array<double>")
    q = v.where("vec_id < 40").toDF("query_id", "query")
    monkeypatch.setattr(retrieval.dense_scan, "BLOCK_BYTES", 7 * 3 * 8)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in retrieval.dense(v, q, 5, exclude_self=True).collect()}
    want = {}
    for i in range(40):
        ranked = sorted((-round(sum(a * b for a, b in zip(vecs[i], vecs[j], strict=True)), 6), j) for j in vecs if j != i)
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(ranked[:5])}
    assert got == want
    labels = {i: "abcdef"[i % 6] if i < 59 else "z" for i in vecs}
    held = v.join(spark.createDataFrame(list(labels.items()), "vec_id bigint, label string"), "vec_id")
    asked = held.where("vec_id < 40 OR vec_id = 59").toDF("query_id", "query", "query_label")
    ranks = {r["query_id"]: r["first_rank"] for r in retrieval.first_match_rank(held, asked, exclude_self=True).collect()}
    for i in range(40):
        ranked = sorted((-round(sum(a * b for a, b in zip(vecs[i], vecs[j], strict=True)), 6), j) for j in vecs if j != i)
        assert ranks.pop(i) == next(r + 1 for r, (_, j) in enumerate(ranked) if labels[j] == labels[i])
    assert not ranks


def test_first_match_beyond_a_million(spark, tmp_path):
    from lakelens.plans import textual

    v = spark.range(1_000_002).selectExpr("20 * id + 1 AS vec_id", "array(float(if(id = 7, 0, 1))) AS embedding", "if(id = 7, 'a', 'b') AS label")
    v.union(spark.sql("SELECT 0L, array(float(1)), 'a'")).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in textual.recall_at_1_5_10(spark, str(tmp_path)).select("query_id", "first_rank", "r10").collect()] == [(0, 1_000_002, 0)]


def test_fusion_metrics_and_pooling(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "query_id int, id string, rank int")
    fused = retrieval.rrf([ranked("abc"), ranked("bd")])
    assert [r["id"] for r in fused.orderBy("rank").collect()] == ["b", "a", "d", "c"]
    nums = spark.createDataFrame([(1, i, r + 1) for r, i in enumerate([10, 20, 30, 40])], "query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 20), (1, 40)], "query_id int, id int")
    m = retrieval.ranking_metrics(nums, gold, [3]).head()
    assert (m["hit"], m["recall"], m["mrr"]) == (1, 0.5, 0.5)
    assert m["ndcg"] == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)
    p = {r["id"]: (r["best_rank"], r["n_conditions"], r["place"]) for r in retrieval.pooled({"x": ranked("abc"), "y": ranked("bd")}).collect()}
    assert p == {"b": (1, 2, 1), "a": (1, 1, 2), "d": (2, 1, 3), "c": (3, 1, 4)}
    cap = spark.createDataFrame([("s", x) for x in (1, 5, 9, 9)] + [("t", 2)], "k string, n int")
    assert {r["k"]: r["cap"] for r in retrieval.waterfill(cap, "k", "n", 16).collect()} == {"s": 5, "t": None}


def test_jaccard_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    sets = {i: sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 8))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, items array<string>")
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j]))}
    assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(df, None, 0.5).collect()} == want


# ---- chunking


def test_chunker_invariants():
    c = chunking.Chunker(target=40, cap=80, overlap=10)
    text = "\n".join(["short one."] + [" ".join(f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(200))] + ["x " * 130] + ["tail"])
    out = c.chunks(text, "H - T | s")
    assert all(c.n(x) <= 80 for x in out) and out[0] == "short one." and out[-1] == "tail"
    words = set(text.split())
    assert words == {w for x in out for w in x.split()}
    assert c.chunks("", "h") == c.chunks(None, "h") == []
    with pytest.raises(ValueError):
        c.chunks("a", "h " * 60)


# ---- guard, scope, comparison


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "select 1 -- ok\n; select 2"])
def test_guard_refuses(sql):
    with pytest.raises(guard.GuardError):
        guard.validate(sql)


@pytest.mark.parametrize("sql", ["SELECT 'a;b DROP' AS x -- set; this", "WITH a AS (SELECT 1 AS n) SELECT * FROM a;", "SELECT /* drop */ 1"])
def test_guard_allows(spark, sql):
    assert guard.run(spark, sql).error is None


def test_guard_details(spark):
    assert guard.with_limit("SELECT 1", 5) == "SELECT 1 LIMIT 5"
    assert guard.with_limit("SELECT * FROM (SELECT 1 LIMIT 2) x", 5).endswith("LIMIT 5")
    assert guard.with_limit("SELECT 1 LIMIT 1", 9, replace=True) == "SELECT 1 LIMIT 9"
    assert guard.no_such_data("```\nno_such_data: salaries.\n```") == "salaries"
    assert guard.conjuncts("SELECT 1 FROM t WHERE a BETWEEN 1 AND 2 AND (b = 1 OR c = 'x AND y') GROUP BY 1") == ("SELECT 1 FROM t", ["a BETWEEN 1 AND 2", "(b = 1 OR c = 'x AND y')"])
    assert guard.conjuncts("SELECT 1 FROM t WHERE a = 1 OR b = 2") is None
    assert guard.lint("SELECT 1 FROM t WHERE a = 'x' IS NULL") == ["null test of a comparison"]
    assert guard.lint("SELECT 1 FROM t WHERE 1 = 1 AND title LIKE 'x'", ["title"]) == ["constant comparison", "filter on title"]
    got = guard.run(spark, "SELECT id FROM range(100)", limit=10)
    assert len(got.rows) == 10 and got.truncated
    slow = guard.run(spark, "SELECT sum(a.id * b.id % 7) FROM range(3000000) a JOIN range(3000000) b ON a.id % 3 = b.id % 3", timeout_s=2)
    assert slow.error == "timed out"
    asked = guard.ask(spark, "q", lambda q, error: "SELECT nope FROM range(3)" if error is None else "SELECT id FROM range(3)")
    assert asked.retried and len(asked.rows) == 3
    assert [guard.route(False, ["x"]), guard.route(True, []), guard.route(None, None)] == ["sql", "vector", "scoped"]
    assert guard.dead_literals([("c", "IN", "x", 1, 0), ("c", "IN", "y", 1, 3), ("c", "=", "z", 0, 0), ("c", "IN", "q", 2, 0)]) == [("c", "=", "z"), ("c", "IN", "q")]
    lists = guard.literals("SELECT 1 FROM t WHERE c IN ('x') AND t.c IN ('z', 'y') AND NOT t.c = 'never' AND c NOT IN ('n')", ["c"])
    assert [(x.op, x.value, x.list) for x in lists] == [("IN", "x", 1), ("IN", "z", 2), ("IN", "y", 2)]


def test_lint_and_replies():
    assert guard.lint("SELECT 1 FROM t WHERE true = flag AND a IS NOT NULL AND b = 'x' AND 'c = 1 IS NULL' = b") == []
    assert guard.lint("SELECT 1 FROM t WHERE (t.a = 'x') IS NOT NULL") == ["null test of a comparison"]
    for bad in ("1 = 1", "('a' <> 'b')", "x = 2 OR TRUE", "NOT (FALSE)"):
        assert guard.lint(f"SELECT 1 FROM t WHERE {bad}") == ["constant comparison"], bad
    assert guard.lint("SELECT 1 FROM t WHERE note NOT ILIKE '%x%'", ["note"]) == ["filter on note"]
    assert guard.lint("SELECT note FROM t WHERE other = 'note = 1'", ["note"]) == []
    assert guard.no_such_data("```\nno_such_data: the weather.\nmore```") == "the weather"
    assert guard.no_such_data(" NO_SUCH_DATA:") == "this information" and guard.no_such_data("SELECT 1") is None
    assert guard.without_fences("so:\n```SQL\nSELECT 1\n```\nthere") == "SELECT 1" and guard.without_fences(" SELECT 2 ") == "SELECT 2"


def test_empty_results():
    from decimal import Decimal

    assert all(compare.is_empty_result(r) for r in ([], [(0,)], [(Decimal("0"),)], [(0.0,)]))
    assert not any(compare.is_empty_result(r) for r in ([(False,)], [(None,)], [(3,)], [(0, 0)], [("0",)], [(0,), (0,)]))


def test_latest_lines_over_batches(spark, tmp_path):
    from lakelens.streaming import streams

    source, target, kept = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: streams.keep_latest(spark.readStream.schema("k int, at int, v string").parquet(source), target, kept, ["k"], "at").awaitTermination()
    write([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")])
    stream()
    write([(1, 3, "d"), (3, 3, "e")])
    stream()
    got = spark.read.parquet(f"{target}/v=1").select("k", "v", "first_seen").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "d", 1), (2, "b", 1), (3, "e", 3)]


def test_scoped_machine(spark):
    spark.createDataFrame([(1, "open", 5), (2, "shut", 50)], "id int, status string, v int").createOrReplaceTempView("_m")
    search = lambda ids: spark.range(3).select(F.col("id").cast("int").alias("id")) if ids is None else ids
    run = lambda where, **k: scoped.retrieve(spark, ["c"], lambda c, h: f"SELECT id FROM _m WHERE {where}", search, {"status": "_m"}, **k)
    assert [r["id"] for r in run("status = 'open'").results.collect()] == [1]
    assert run("status = 'gone'").status == "value_not_found"
    assert run("status = 'open' AND v > 10").status == "zero_match"
    assert run("status = 'open' AND v > 99").status == "unproven_zero"
    assert run("1 = 1").status == "sql_failed"
    assert scoped.retrieve(spark, [], None, search, {}).results.count() == 3
    assert run("v > 0", limit=1).truncated


def test_scope_holds_all_ids(spark):
    spark.range(60_000).selectExpr("id", "'open' AS status").createOrReplaceTempView("_many")
    run = lambda end, **k: scoped.retrieve(spark, ["c"], lambda c, h: f"SELECT id FROM _many WHERE status = 'open'{end}", lambda ids: ids, {"status": "_many"}, **k)
    for end in ("", " LIMIT 7", " LIMIT 7 OFFSET 2"):
        out = run(end)
        assert (out.results.count(), out.n_ids, out.truncated, out.weak) == (60_000, 60_000, False, True)
    out = run("", limit=10)
    assert (out.results.count(), out.truncated) == (60_000, True)


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "n int, s string")
    assert compare.same_rows(a, a.select("s", F.col("n").cast("double")))
    assert not compare.same_rows(a, a.distinct())
    assert compare.score(a, a.select(F.col("s"), F.col("n").alias("m")), ["n"]) == (False, "columns_unmatched")
    assert compare.score(None, a) == (None, "no gold result")
    assert compare.unreproduced("1,234 rows, 0.98, 77", [(1234, 0.9812)]) == ["77"]
    assert compare.is_empty_result([(0,)]) and not compare.is_empty_result([(0, 1)])


def test_records(spark):
    rows = [{"id": i, "route": r, "level": "L1"} for i, r in enumerate(["a", "a", "a", "b"])]
    assert [r["id"] for r in records.balanced_pick(rows, 3, ("route",))] == [0, 3, 1]
    maps = spark.createDataFrame([(1, {"a": 1.0}), (1, {"a": 2.0, "b": 1.0})], "k int, m map<string,double>")
    assert records.merged_maps(maps, "k", "m").head()["m"] == {"a": 3.0, "b": 1.0}
    journal = spark.createDataFrame([("x", 1, "new"), ("y", 2, "new"), ("x", 3, "done")], "k string, line int, s string")
    assert {(r["k"], r["s"], r["first_seen"]) for r in records.collapse(journal, ["k"], "line").collect()} == {("x", "done", 1), ("y", "new", 2)}
    assert [r["k"] for r in records.pending(spark.createDataFrame([("x",), ("z",)], "k string"), journal, ["k"]).collect()] == ["z"]


def test_latest_wins_stream(spark, tmp_path):
    from lakelens.streaming.streams import keep_latest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps(x) + "\n" for x in [{"k": "a", "n": 1, "s": "x"}, {"k": "a", "n": 2, "s": "y"}, {"k": "b", "n": 3, "s": "z"}]))
    stream = spark.readStream.schema("k string, n int, s string").json(str(src))
    keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "n").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "v=0"))
    assert {(r["k"], r["s"], r["first_seen"]) for r in got.collect()} == {("a", "y", 1), ("b", "z", 3)}


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
