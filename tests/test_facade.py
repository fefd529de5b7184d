import json

import pytest
from pyspark.sql import functions as F

from lakelens.cli import main
from lakelens.engine import Engine
from lakelens.operators import bankfile, verify
from lakelens.plans.textual import _RECORD, bag_vector

DOCS = [(1, "graphene sensors for medicine", "open"), (2, "wind turbines and storms", "open"), (3, "graphene batteries store wind power", "shut"), (4, "", "open")]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, text string, status string")
    return Engine(spark, docs, bag_vector, write_sql=lambda q, e: "SELECT count(*) AS n FROM corpus", narrow=lambda c, h: "SELECT id FROM corpus WHERE " + " AND ".join(c), facts=lambda q: (not q.startswith("how many"), ["status = 'open'"] if "open" in q else []), guarded={"status": "corpus"})


def test_retrievers_and_routes(engine):
    for name in ("lexical", "dense", "hybrid", "hybrid_rerank"):
        assert engine.search("graphene sensor", 2, name)[0][1] == 1
    with pytest.raises(ValueError):
        engine.search("x", retriever="other")
    assert engine.ask("how many are there").rows == [(4,)]
    assert engine.ask("wind power").mode == "vector"
    out = engine.ask("open wind power")
    assert out.mode == "scoped" and {r[1] for r in out.rows} <= {1, 2, 4} and "complete" in out.note
    assert engine.context("graphene", budget=8).count() == 1


def test_verification(spark, engine):
    items = [{"owner": "a", "sql": "SELECT count(*) FROM corpus", "claim": "4 documents"}, {"owner": "b", "sql": "SELECT count(*) FROM corpus", "claim": "5 documents"}, {"owner": "c", "sql": "SELECT * FROM corpus WHERE status = 'x'", "expect_empty": True}]
    assert {r["owner"]: r["status"] for r in verify.verify(spark, items).collect()} == {"a": "PASS", "b": "FAIL", "c": "PASS"}
    assert verify.survivors(spark, "q", "SELECT id FROM corpus WHERE status = 'open'", [1, 2, 4]).status == "PASS"
    record = {"question_id": "q", "expected_route": "hybrid", "level": "L1", "subtype": "filter-read", "gold_project_ids": [1], "filter_evidence": {"filter_sql": "SELECT id FROM corpus WHERE status = 'open'", "survivor_ids": [1, 2]}}
    assert {c.name: c.status for c in verify.precheck(spark, record)} == {"SURVIVORS": "FAIL", "GOLD-SURVIVES": "PASS", "WINDOW": "PASS", "LEVEL": "PASS"}
    entries = spark.createDataFrame([("m1", "wind / power", "storms and turbines", [2, 3], [2, 3], [3]), ("m2", "wind / power", "wind power", [9], [1, 4], [9])], "owner string, bucket string, about string, read_first array<bigint>, read array<bigint>, used array<bigint>")
    corpus = spark.createDataFrame([(i, t != "") for i, t, _ in DOCS], "id bigint, has_text boolean")
    buckets = spark.createDataFrame([(2, "wind / power"), (3, "wind / power")], "id bigint, bucket string")
    got = {(r["owner"], r["name"]): r["status"] for r in verify.map_entry(entries, corpus, buckets).collect()}
    assert {n for (o, n), s in got.items() if o == "m1" and s == "FAIL"} == set()
    assert {n for (o, n), s in got.items() if o == "m2" and s == "FAIL"} == {"TEXT", "BUCKET", "READ-FIRST", "INDEPENDENT", "LABEL-ECHO"}


def test_precheck_runs_statements_again(spark, engine):
    twins = [("dead", "sql", "L1", "SELECT id FROM corpus WHERE status = 'x'", None), ("live", "sql", "L1", "SELECT id FROM corpus", None), ("bare", "vector", "L1", None, [4]), ("text", "vector", "L1", None, [1]), ("adv", "adversarial", "L1", None, None)]
    bank = spark.createDataFrame(twins, "question_id string, expected_route string, level string, gold_sql string, gold_project_ids array<bigint>")
    corpus = spark.createDataFrame([(i, t != "") for i, t, _ in DOCS], "id bigint, has_text boolean")
    got = lambda **r: {c.name: c.status for c in verify.precheck(spark, {"question_id": "q"} | r, bank, corpus, "h1")}
    adv = {"expected_route": "adversarial", "subtype": "zero-match", "gold_project_ids": [], "absence_evidence": [{"sql": "SELECT * FROM corpus WHERE status = 'x'", "expect": "zero"}]}
    for twin, exists, live in [("dead", "PASS", "FAIL"), ("live", "PASS", "PASS"), ("bare", "PASS", "FAIL"), ("text", "PASS", "PASS"), ("adv", "FAIL", None), ("q", "FAIL", None), ("no", "FAIL", None), (None, "FAIL", None)]:
        out = got(**adv, twin_id=twin)
        assert (out["TWIN-EXISTS"], out.get("TWIN-LIVE"), out["EVIDENCE"], out["GOLD-EMPTY"]) == (exists, live, "PASS", "PASS"), twin
    hybrid = {"expected_route": "hybrid", "level": "L1", "subtype": "filter-compare", "gold_project_ids": [1, 3], "schema_docs_hash": "h0"}
    out = got(**hybrid, filter_evidence={"filter_sql": "SELECT id FROM corpus WHERE status = 'shut'", "survivor_ids": [1, 2, 3]})
    assert out == {"GOLD-TEXT": "PASS", "SURVIVORS": "FAIL", "GOLD-SURVIVES": "FAIL", "WINDOW": "WARN", "LEVEL": "PASS", "SCHEMA-DOCS": "FAIL"}
    out = got(expected_route="sql", level="L1", gold_sql="SELECT id FROM corpus", answer_columns=["ID", "cost"], gold_project_ids=[4, 9], schema_docs_hash="h1")
    assert out == {"GOLD-SQL": "PASS", "ANSWER-COLUMNS": "FAIL", "GOLD-TEXT": "FAIL", "SCHEMA-DOCS": "PASS"}
    assert verify.survivors(spark, "q", "SELECT id FROM range(6000)", list(range(5000))).status == "FAIL"


def test_decisions_and_findings_fold(spark):
    from lakelens.operators import records

    d = lambda r, x, why: (r, x, "t", why)
    lines = [
        ("a", 1, [d(1, "FIX", "one")], [("c", "high", "x", None), ("c", "low", "y", None)]),
        ("a", 2, [d(1, "FIX", "one, again"), d(2, "OK", "two")], [("c", "high", "x", "upheld")]),
        ("a", 3, None, None),
        ("b", 1, [d(1, "FIX", "one")], None),
        ("b", 2, [d(2, "FIX", "two")], []),
        ("b", 3, [d(2, "FIX", "two"), d(3, "OK", "three")], None),
    ]
    schema = "k string, line int, judge_decisions array<struct<round:int,disposition:string,targets:string,rationale:string>>, findings array<struct<class:string,severity:string,claim:string,ruling:string>>"
    got = {r["k"]: ([x["rationale"] for x in r["decisions"]], [(x["claim"], x["ruling"]) for x in r["findings"] or []]) for r in records.folded_slots(spark.createDataFrame(lines, schema), "k", "line").collect()}
    assert got == {"a": (["one, again", "two"], [("x", "upheld"), ("y", None)]), "b": (["one", "two", "three"], [])}


def test_bank_changes_all_at_once(spark, tmp_path):
    row = lambda q, twin=None: (q, f"text of {q}", "sql", "L1", None, "SELECT 1", None, None, twin, None)
    bank, old = f"file://{tmp_path}/bank", f"file://{tmp_path}/old"
    assert bankfile.promote(spark, bank, spark.createDataFrame([row("q1"), row("q2", "q1")], _RECORD)) == 2
    with pytest.raises(ValueError, match="repeated id"):
        bankfile.promote(spark, bank, spark.createDataFrame([row("q1")], _RECORD))
    with pytest.raises(ValueError, match="twins"):
        bankfile.archive(spark, bank, old, ["q1"], "x")
    assert bankfile.archive(spark, bank, old, ["q2"], "x") == 1
    assert [r[0] for r in bankfile.current(spark, bank).select("question_id").collect()] == ["q1"]
    assert bankfile.current(spark, old).select(F.col("reason")).head()[0] == "x"
    # A failure after the archive was written: the record is in both, and trying again doubles none.
    bankfile.swap(bankfile.current(spark, bank).unionByName(spark.createDataFrame([row("q2", "q1")], _RECORD)), bank)
    assert bankfile.archive(spark, bank, old, ["q2"], "y") == 1
    assert [tuple(r) for r in bankfile.current(spark, old).select("question_id", "reason").collect()] == [("q2", "y")]
    before = bankfile.current(spark, bank)
    bankfile.promote(spark, bank, spark.createDataFrame([row("q3")], _RECORD))
    assert before.count() == 1 and bankfile.current(spark, bank).count() == 2  # a reader of the version before goes on


def test_commands(spark, capsys):
    assert main(["queries"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["sql", "/root/testdata/sf0.001", "SELECT count(*) AS n FROM region"]) == 0
    assert '{"n": 5}' in capsys.readouterr().out
    assert main(["sql", "/root/testdata/sf0.001", "DROP TABLE region"]) == 1


def test_more_commands(spark, tmp_path, capsys):
    said = lambda: capsys.readouterr().out
    at = lambda name: f"{tmp_path}/{name}"
    docs = [(1, "red lenses and mirrors"), (2, "a blue sky\n" + "x" * 3000), (3, "mirrors of the sky")]
    spark.createDataFrame(docs, "id bigint, text string").write.parquet(at("docs"))
    assert main(["index-fresh", at("docs"), at("index")]) == 1
    assert main(["build-index", at("docs"), at("index")]) == 0 and '"rows": 3' in said()
    assert main(["index-fresh", at("docs"), at("index")]) == 0
    assert main(["search-index", at("index"), "mirror"]) == 0 and "|     3|" in said()
    spark.createDataFrame([(7, "mirror sky")], "query_id bigint, query string").write.parquet(at("questions"))
    spark.createDataFrame([(7, 3)], "query_id bigint, id bigint").write.parquet(at("gold"))
    assert main(["bench-retrievers", at("docs"), at("questions"), at("gold")]) == 0 and "| lexical | 10 | 1 | 1.0 | 1.0 | 1.0 | 1.0 |" in said()
    assert main(["chunk-stats", at("docs")]) == 0 and "|         4|     1|" in said()
    spark.createDataFrame([(1, "h", "report", "summary", "one\ntwo")], "project_id bigint, header string, source string, section string, text string").write.parquet(at("sections"))
    assert main(["chunk", at("sections"), at("chunks")]) == 0 and spark.read.parquet(at("chunks")).head()["text"] == "one\ntwo"
    (tmp_path / "x.csv").write_text('"id";"note"\n"1";"say ""hi"""\nbroken\n')
    assert main(["stage-csv", at("x.csv"), at("staged")]) == 1 and "not quoted" in said()
    bank = [{"question_id": f"sql-{i}", "text": f"Which lasers of kind {i} are measured in Spain today?", "expected_route": "sql", "level": f"L{1 + i % 2}", "gold_project_ids": [i // 2], "twin_id": "t1" if i < 2 else None} for i in range(4)]
    (tmp_path / "bank.jsonl").write_text("\n".join(json.dumps(r) for r in bank))
    (tmp_path / "none.jsonl").write_text("")
    (tmp_path / "plan.md").write_text("| route | L1 | L2 |\n|---|---|---|\n| sql | 5 | 2 |\n")
    assert main(["gap-report", at("bank.jsonl"), at("none.jsonl"), at("plan.md")]) == 0 and "|     5|     2|     0|      3|" in said()
    assert main(["next-ids", at("bank.jsonl"), "--wanted", "1"]) == 0 and "|   sql|  4|" in said()
    assert main(["pick", at("bank.jsonl"), "--n", "2"]) == 0 and said().split() == ["sql-0", "sql-1"]
    assert main(["near-duplicates", at("bank.jsonl")]) == 1 and "sql-1" in said()
    assert main(["collisions", at("bank.jsonl"), at("none.jsonl")]) == 0
    out = said()
    assert "sql-0" in out and "t1" in out
    assert main(["bad-lines", at("x.csv")]) == 1
    assert main(["catalog", "/root/testdata/sf0.001"]) == 0 and "r_name" in said()
    (tmp_path / "journal.jsonl").write_text('{"slot": "s", "status": "ACCEPTED", "candidate_index": 1}\n')
    assert main(["journal-stats", at("journal.jsonl")]) == 0 and "candidates tried" in said()
    assert main(["run-report", at("nothing")]) == 0 and "## Passed" in said()
    assert main(["latest", at("nothing")]) == 0


def test_engine_searches_a_stored_index(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox fox"), (3, None)], "id bigint, text string")
    engine = Engine(spark, docs, stemmed=False)
    assert engine.index.meta["rows"] == 3 and [(r["id"], r["rank"]) for r in engine.ranking("fox", 5, "lexical").orderBy("rank").collect()] == [(2, 1), (1, 2)]
