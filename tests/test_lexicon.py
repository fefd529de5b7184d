"""The segmented index against BM25 by hand over all postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.operators import lexicon, retrieval
from lakelens.plans import textual
from lakelens.storage import new_path


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30
    return {i * 7 - 20: " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 10, 40]))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)


def asked(spark, n=25, seed=9):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)] + ["the", "The", "none"], k=rng.randint(1, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (100, ""), (101, None)], "query_id bigint, query string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def full(spark, docs, q, k=10, allowed=None):
    terms, lengths = retrieval.postings(frame(spark, docs), "doc_id", F.col("text"))
    return rows(retrieval.bm25(terms, lengths, q, k, allowed=allowed))


def found(index, q, k=10, allowed=None):
    return rows(lexicon.search(index, q, k, allowed).ranking)


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(lexicon, "SHARD_DOCS", 100)


def test_equals_all_postings_and_skips_blocks(spark, small_shards):
    docs, q = texts(700), asked(spark)
    index = lexicon.create(frame(spark, docs), "doc_id", F.col("text"), new_path(spark, "t"))
    assert index.meta["segments"][0]["shards"] == 7
    for k in (1, 10, 1000):
        assert found(index, q, k) == full(spark, docs, q, k)
    told = lexicon.search(index, q, 3).stats.agg(F.sum("blocks").alias("b"), F.sum("blocks_read").alias("r")).first()
    assert 0 < told["r"] < told["b"]
    few = frame(spark, docs).where("doc_id % 5 = 0 OR doc_id > 4000").select("doc_id").unionByName(spark.createDataFrame([(10**9,), (None,)], "doc_id bigint"))
    assert found(index, q, 10, few) == full(spark, docs, q, 10, few)
    assert found(index, q, 10, few.where("false")) == []
    assert {(r["term"], r["doc_id"], r["tf"], r["dl"]) for r in lexicon.postings(index).collect()} == {(r["term"], r["doc_id"], r["tf"], r["dl"]) for r in retrieval.postings(frame(spark, docs), "doc_id", F.col("text"))[0].collect()}


def test_bounds_hold(small_shards):
    rng = np.random.default_rng(4)
    places, tfs, dl = np.arange(64, dtype=np.int32), rng.integers(1, 9, 64).astype(np.int32), np.sort(rng.integers(5, 90, 64))
    ends = np.arange(8, 65, 8, dtype=np.int32)
    block_tf = np.maximum.reduceat(tfs, ends - 8)
    shard = lexicon._Shard(np.arange(64), dl, np.zeros(64), np.ones(64, bool), [("a", places, tfs, ends, block_tf, np.minimum.reduceat(dl, ends - 8))])
    for avgdl in (1.0, 30.0, 500.0):
        bounds, of_block, _, of_place, weights = lexicon._weighed(shard, {"a": 0}, {"a": 2.0}, avgdl)[0]
        assert all(weights[of_place == r].max() <= bounds[of_block == r][0] + 1e-12 for r in range(8))


def test_append_edit_delete_equal_a_rebuild(spark, small_shards):
    docs, q, path = texts(300), asked(spark), new_path(spark, "t")
    index = lexicon.create(frame(spark, docs), "doc_id", F.col("text"), path)
    more = {i: t for i, t in texts(360, 5).items() if i not in docs}
    edits = {i: f"w1 w2 {i} the" for i in list(docs)[:40]}
    index = lexicon.change(index, frame(spark, more))
    index = lexicon.change(index, frame(spark, edits), deleted=frame(spark, docs).where("doc_id > 2000 AND doc_id < 2050").select("doc_id"))
    now = {i: t for i, t in (docs | more | edits).items() if not 2000 < i < 2050}
    assert index.meta["gone"] and index.meta["rows"] == len(now) and len(index.meta["segments"]) == 3
    assert found(index, q) == full(spark, now, q)
    held = lexicon.open_lexicon(spark, path)
    assert held.meta == index.meta and lexicon.fresh(held, frame(spark, now), "doc_id", F.col("text"))
    merged = lexicon.merge(held, everything=True)
    assert len(merged.meta["segments"]) == 1 and not merged.meta["gone"] and merged.meta["digest"] == held.meta["digest"]
    assert found(merged, q) == full(spark, now, q)
    assert sorted((r["doc_id"], sorted(zip(r["terms"], r["tfs"]))) for r in lexicon.terms_of_documents(merged).collect())[0][0] == min(now)


def test_sync_touches_what_changed_and_edits_make_stale(spark, small_shards):
    docs, path = texts(250), new_path(spark, "t")
    index = lexicon.create(frame(spark, docs), "doc_id", F.col("text"), path)
    same = lexicon.sync(index, frame(spark, docs), "doc_id", F.col("text"))
    assert same.meta["version"] == 1
    now = dict(docs)
    now[1] = "w3 edited"  # an edited text of a table of the same count
    del now[8]
    now[5000] = "w4 new"
    assert not lexicon.fresh(index, frame(spark, now), "doc_id", F.col("text"))
    index = lexicon.sync(index, frame(spark, now), "doc_id", F.col("text"))
    assert index.meta["segments"][-1]["rows"] == 2 and lexicon.fresh(index, frame(spark, now), "doc_id", F.col("text"))
    assert found(index, asked(spark)) == full(spark, now, asked(spark))
    emptied = lexicon.sync(index, frame(spark, now).where("false"), "doc_id", F.col("text"))
    assert emptied.meta["rows"] == 0 and found(emptied, asked(spark)) == []


def test_like_sizes_merge(spark, small_shards):
    docs, q, path = {}, asked(spark, 5), new_path(spark, "t")
    index = lexicon.create(frame(spark, {}), "doc_id", F.col("text"), path)
    for i in range(4):
        part = {100 * i + j: f"w{j} w{i} the" for j in range(20)}
        docs |= part
        index = lexicon.change(index, frame(spark, part))
    assert [s["rows"] for s in index.meta["segments"] if s["rows"]] == [80]
    assert found(index, q) == full(spark, docs, q)


def test_two_writers_of_a_version(spark):
    index = lexicon.create(frame(spark, {1: "a"}), "doc_id", F.col("text"), new_path(spark, "t"))
    lexicon.change(index, frame(spark, {2: "b"}))
    with pytest.raises(lexicon.Conflict):
        lexicon.change(index, frame(spark, {3: "c"}))
    assert lexicon.open_lexicon(spark, index.path).meta["rows"] == 2


def test_a_search_shuffles_no_lists(spark, small_shards):
    index = lexicon.create(frame(spark, texts(700)), "doc_id", F.col("text"), new_path(spark, "t"))
    held = lexicon._beside(index)
    assert held.count() == 7 and "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    n = {r["term"]: r["n"] for r in lexicon.counts(index, ["w1", "w2", "nowhere"]).collect()}
    want = lexicon.postings(index, spark.createDataFrame([("w1",), ("w2",), ("nowhere",)], "term string")).groupBy("term").count()
    assert n and n == {r["term"]: r["count"] for r in want.collect()}


def test_texts_come_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    lexicon.create(frame(spark, {1: "a b", 2: None}), "doc_id", F.col("text"), new_path(spark, "t"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_bags_come_from_the_index_without_a_shuffle(spark):
    docs = {1: "the W1 w22, w1; Zz 9", 2: None, 3: "..", 4: "q" * 70 + " a"}
    index = lexicon.create(frame(spark, docs), "doc_id", F.col("text"), new_path(spark, "t"))
    bags = textual.bag_vectors(lexicon.terms_of_documents(index))
    assert "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()
    direct = frame(spark, docs).select("doc_id", textual.bag_vector(F.col("text")).alias("v")).where("v is not null")
    assert {r["vec_id"]: r["embedding"] for r in bags.collect()} == {r["doc_id"]: r["v"] for r in direct.collect()} and direct.count() == 2
