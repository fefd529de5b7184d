"""What stops and goes on: embeddings by fingerprint, steps and latest lines of streams, versions of a bank."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakelens.operators import bankfile, embedding, records, runs
from lakelens.storage import new_path, set_conf
from lakelens.streaming import steps, streams


def length_vector(text):
    return F.when(F.length(text) > 0, F.array(F.length(text).cast("double"), F.lit(1.0)))


def test_a_stopped_run_embeds_only_the_rest(spark):
    texts = [(i, f"text {i % 40}" if i % 7 else None) for i in range(100)]
    chunks, path = spark.createDataFrame(texts, "chunk bigint, text string").repartition(3), new_path(spark, "t")
    assert embedding.embed_missing(chunks, path, length_vector, "m", 10, most_batches=2) == 2
    first = embedding.stored(spark, path).count()
    os.makedirs(f"{path.removeprefix('file:')}/batch-dead/_temporary")  # what a killed batch leaves
    with pytest.raises(ValueError, match="lacks"):
        embedding.vectors(chunks, path, "chunk")
    before = set(embedding.committed(spark, path))
    assert embedding.embed_missing(chunks, path, length_vector, "m", 1000) == 1
    added = set(embedding.committed(spark, path)) - before
    rest = spark.read.parquet(*added)
    assert first > 0 and rest.count() + first == embedding.stored(spark, path).select("fingerprint").distinct().count() == len({t or "" for _, t in texts})
    got = {r["chunk"]: r["embedding"] for r in embedding.vectors(chunks, path, "chunk").collect()}
    assert got == {i: [float(len(t)), 1.0] if t else None for i, t in texts}
    assert embedding.embed_missing(chunks, path, length_vector, "m", 10) == 0
    edited = chunks.withColumn("text", F.when(F.col("chunk") == 8, "edited").otherwise(F.col("text")))
    assert embedding.embed_missing(edited, path, length_vector, "m", 10) == 1 and embedding.vectors(edited, path, "chunk").count() == 100
    with pytest.raises(ValueError, match="of m"):
        embedding.embed_missing(chunks, path, length_vector, "other")


def test_streamed_steps_equal_batch_steps(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.randint(0, 5000) * 60, rng.choice(["open", "work", "work", "error"])) for _ in range(250)]
    events = spark.createDataFrame(rows, "who int, s bigint, kind string").select("who", F.timestamp_seconds("s").alias("ts"), "kind").dropDuplicates(["who", "ts"])
    path, end = new_path(spark, "in"), new_path(spark, "end")
    events.repartition(3).write.parquet(path)  # in no order
    spark.range(1).select(F.lit(None).cast("int").alias("who"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit("end").alias("kind")).write.parquet(end)
    events = spark.read.parquet(path)
    opens, ends = F.col("kind") == "open", F.col("kind") != "error"
    source, closing = (spark.readStream.schema(events.schema).parquet(p) for p in (path, end))
    found = steps.run_steps(spark, source, closing, "who", "ts", opens, ends).where("key is not null").collect()
    want = {r["who"]: (r["n_steps"], r["active"]) for r in records.steps(events, "who", "ts", opens, ends).collect()}
    got = {}
    for r in found:
        n, active = got.get(int(r["key"]), (0, 0.0))
        got[int(r["key"])] = n + 1, active + max((r["ended"] or r["first"]) - r["first"], 0) / 1e6
    assert {k: (n, round(a, 3)) for k, (n, a) in got.items()} == want
    split = steps.run_steps(spark, source, closing, "who", "ts", opens, ends, idle_ms=1)
    assert split.where("key is not null").count() >= len(found)


def test_keys_of_a_stream_share_state(spark):
    """Six thousand keys in state are a few rows for each bucket, not some for each key and event."""
    path, end = new_path(spark, "in"), new_path(spark, "end")
    spark.range(18000).select((F.col("id") % 6000).cast("string").alias("who"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 2 == 0).alias("o")).write.parquet(path)
    spark.range(1).select(F.lit(None).cast("string").alias("who"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(True).alias("o")).write.parquet(end)
    source, closing = (spark.readStream.schema("who string, ts timestamp, o boolean").parquet(p) for p in (path, end))
    with set_conf(spark, spark__sql__streaming__stateStore__providerClass=steps.PROVIDER):
        found = steps.stream_steps(source.unionByName(closing), "who", "ts", F.col("o"), F.lit(True))
        run = found.writeStream.format("parquet").option("path", new_path(spark, "out")).option("checkpointLocation", new_path(spark, "kept")).trigger(availableNow=True).start()
        run.awaitTermination()
    held = [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    assert 0 < max(held) < 6000


def test_a_stream_that_goes_on_leaves_out_late_events_only(spark):
    path, sink, kept = (new_path(spark, n) for n in ("in", "out", "kept"))
    for seconds in ([0, 10, 100_000], [5, 99_500, 200_000], [7_000_000_000]):
        spark.createDataFrame([("a" if s < 1_000_000 else None, s) for s in seconds], "who string, s bigint").select("who", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(path)
        with set_conf(spark, spark__sql__streaming__stateStore__providerClass=steps.PROVIDER):
            found = steps.stream_steps(spark.readStream.schema("who string, ts timestamp").parquet(path), "who", "ts", F.lit(True), F.lit(True))
            found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(steps.STEP).parquet(sink).where("key is not null").orderBy("first").collect()
    assert [(r["step"], r["first"] // 1_000_000) for r in got] == [(1, 0), (2, 10), (3, 99_500), (4, 100_000), (5, 200_000)]


def test_steps_assembled_in_several_rounds_equal_a_loop():
    rng = random.Random(8)
    never = pa.Table.from_pylist([], steps._STEP)
    for idle in (50, steps.IDLE_MS):
        waiting, held, got, want, loop = [], never, [], [], {}
        for passed in (0, 300, 301, 700, 1500):
            fresh = [{"key": rng.choice(["a", "b", "ü", None]), "at": rng.randint(passed * 1000, 1_600_000), "opens": rng.random() < 0.3, "ends": rng.random() < 0.6} for _ in range(40)]
            fresh += [dict(e, opens=not e["opens"]) for e in fresh[:5]]
            waiting += fresh
            ready = sorted((e["at"], e["opens"], e["ends"], e["key"]) for e in waiting if e["at"] // 1000 < passed and e["key"] is not None)
            ready += sorted((e["at"], e["opens"], e["ends"], e["key"]) for e in waiting if e["at"] // 1000 < passed and e["key"] is None)
            over, held, later, wake = steps.assemble(held, pa.Table.from_pylist(waiting, steps._EVENT), passed, idle)
            waiting = [e for e in waiting if e["at"] // 1000 >= passed]
            for at, opens, ends, key in ready:
                step = loop.get(key)
                if opens or step is None:
                    want += [(key, *step)] if step else []
                    loop[key] = (step[0] + 1 if step else int(opens), at, at, at if ends else None)
                else:
                    loop[key] = (step[0], step[1], at, at if ends else step[3])
            busy = {e["key"] for e in waiting}
            for key in [k for k, x in loop.items() if x[2] // 1000 + idle < passed and k not in busy]:
                want.append((key, *loop.pop(key)))
            got += [tuple(r.values()) for r in over.to_pylist()]
            assert sorted(map(str, later.to_pylist())) == sorted(map(str, waiting))
            assert {r["key"]: tuple(r.values())[1:] for r in held.to_pylist()} == loop
            assert wake == min([x[2] // 1000 + idle + 1 for k, x in loop.items() if k not in busy] + [e["at"] // 1000 + 1 for e in waiting], default=None)
        assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_batches_rewrite_only_their_buckets(spark):
    source, target, kept = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: streams.keep_latest_buckets(spark.readStream.schema("k int, at int, v string").parquet(source), target, kept, ["k"], "at", 16).awaitTermination()
    files = lambda: {(d, f) for d, _, fs in os.walk(target.removeprefix("file:")) for f in fs if f.endswith(".parquet")}
    write([(i, 1, "a") for i in range(200)])
    run()
    before = files()
    write([(7, 3, "b"), (7, 2, "c"), (900, 5, "d")])
    run()
    after = files()
    assert len(before) == 16 and 14 <= len(before & after) < 16 and len(after) == 16
    got = {r["k"]: (r["at"], r["v"], r["first_seen"]) for r in spark.read.parquet(target).collect()}
    assert len(got) == 201 and got[7] == (3, "b", 1) and got[900] == (5, "d", 5) and got[8] == (1, "a", 1)


def test_of_two_writers_one_starts_again(spark):
    path = new_path(spark, "bank")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "question_id string")
    bankfile.swap(frame("a"), path, None)
    before = bankfile._version(spark, path)
    bankfile.swap(frame("a", "b"), path, before)
    with pytest.raises(bankfile.Conflict):
        bankfile.swap(frame("a", "c"), path, before)
    late = [0]

    def added(bank):
        if not late[0]:  # another writer comes between
            late[0] = 1
            bankfile._changed(spark, path, lambda b: b.unionByName(frame("d")))
        return bank.unionByName(frame("c"))

    bankfile._changed(spark, path, added)
    assert sorted(r[0] for r in bankfile.current(spark, path).collect()) == ["a", "b", "c", "d"]


def test_long_texts_are_told_apart_by_all_of_them(spark):
    same = "x" * 300
    lines = [("s", 1, [(1, "keep", ["t"], same + "a"), (1, "keep", ["t"], same + "b")], [("c", "HIGH", same + "a"), ("c", "HIGH", same + "b")])]
    schema = "k string, line int, judge_decisions array<struct<round: int, disposition: string, targets: array<string>, rationale: string>>, findings array<struct<class: string, severity: string, claim: string>>"
    got = records.folded_slots(spark.createDataFrame(lines + [("s", 2, [(2, "drop", ["t"], same + "c")], None)], schema), "k", "line").head()
    assert len(got["decisions"]) == 3 and len(got["findings"]) == 2


def test_answers_are_scored_whole(spark):
    from lakelens.engine import Engine

    spark.range(3000).createOrReplaceTempView("_many_rows")
    docs = spark.createDataFrame([(1, "a")], "id bigint, text string")
    engine = Engine(spark, docs, write_sql=lambda q, e: "SELECT id FROM _many_rows WHERE id < 2500", stemmed=False)
    asked = {"text": "which?", "gold_sql": "SELECT id FROM _many_rows WHERE id < 2500", "gold_project_ids": None, "answer_columns": None}
    out = runs.one_question(engine, asked, "force-sql", 5)
    assert (out["passed"], out["n_rows"]) == (True, 1000)
    broken = runs.one_question(engine, asked | {"gold_sql": "SELECT nothing FROM nowhere"}, "force-sql", 5)
    assert broken["passed"] is None and broken["reason"].startswith("gold failed")


def test_weighted_samples_have_their_size_and_follow_weights(spark):
    from lakelens.sources import readers

    rows = [(i, "abc"[i % 3] if i < 900 else "d", (10.0 if i % 2 else 1.0) if i % 50 else None) for i in range(905)]
    df = spark.createDataFrame(rows, "id bigint, s string, w double").repartition(7)
    got = readers.stratified_sample(df, 60, "s", "id", F.col("w")).collect()
    by = {s: [r["id"] for r in got if r["s"] == s] for s in "abcd"}
    assert [len(by[s]) for s in "abcd"] == [60, 60, 60, 4] and all(sorted(r["place"] for r in got if r["s"] == s) == list(range(1, len(by[s]) + 1)) for s in "abcd")
    assert sum(i % 2 for s in "abc" for i in by[s]) > 120 and all(w is not None for i, _, w in rows if i in by["a"])
    again = readers.stratified_sample(df.repartition(3), 60, "s", "id", F.col("w")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_each_bad_xml_file_is_an_error(spark, tmp_path):
    from lakelens.sources import readers

    for name, text in {"a": "<r><id>1</id><t>x</t></r>", "b": "<r><id>2</id>", "c": "<r><id>no</id><t>y</t></r>", "d": "", "e": "<r>\n<id>5</id>\n</r>"}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    good, ill = readers.read_xml_files(spark, str(tmp_path), "id bigint, t string")
    assert sorted((r["id"], r["t"]) for r in good.collect()) == [(1, "x"), (5, None)]
    assert sorted(r["file"][-5:] for r in ill.collect()) == ["b.xml", "c.xml"]  # an empty file holds no record
