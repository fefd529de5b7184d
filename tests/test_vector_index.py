"""The vector index against an exact search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakelens.operators import retrieval, vector_index
from lakelens.storage import new_path

GIVEN = "/root/testdata/sf0.1/embeddings.parquet"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)


def clustered(n=1500, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims)) * 4
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(30)] + rng.normal(size=dims) * 0.3]) for i in range(n)]


def asked(v):
    return v.where("vec_id % 20 = 0").toDF("query_id", "query")


def ranking(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def recall(found, want):
    near = lambda r: {(q, v) for (q, _), (v, _) in r.items()}
    return len(near(found) & near(want)) / len(want)


def test_every_vector_is_indexed_and_few_cells_find_clusters(spark):
    rows = clustered() + [(9003, None), (9001, [1.0]), (9002, [float("nan")] * 6), (None, [1.0] * 6)]
    v = frame(spark, rows)
    index = vector_index.store(v, new_path(spark, "t"))
    assert index.meta["rows"] == 1500 == index.vectors.select("vec_id").distinct().count()
    want = ranking(retrieval.dense(v, asked(v), 5, exclude_self=True))
    probes = vector_index.probes_for(index, 0.95, 5)
    found = vector_index.search(index, asked(v), 5, probes, exclude_self=True)
    assert probes < index.meta["cells"] / 3 and recall(ranking(found.ranking), want) >= 0.9
    assert all(not r["short"] and r["fetch_k"] >= 5 for r in found.stats.collect())


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet(GIVEN).select("vec_id", "embedding")
    index = vector_index.store(v, new_path(spark, "t"))
    probes = vector_index.probes_for(index)
    found = vector_index.search(index, asked(v), 10, min(probes, index.meta["cells"] // 2 - 1), exclude_self=True)
    assert found.stats.where("probes < {}".format(index.meta["cells"])).count() == 100
    want = ranking(retrieval.dense(v, asked(v), 10, exclude_self=True))
    assert recall(ranking(vector_index.search(index, asked(v), 10, probes, exclude_self=True).ranking), want) >= 0.9


def test_filters_widen_until_enough_survive(spark, monkeypatch):
    v = frame(spark, clustered(2400))
    index = vector_index.store(v, new_path(spark, "t"), cells=64)
    every = v.where("vec_id % 3 = 0").select("vec_id")
    few = v.where("vec_id < 12").select("vec_id")
    monkeypatch.setattr(vector_index.scan, "BLOCK_BYTES", 60 * 50)  # several blocks of queries
    wide = vector_index.search(index, asked(v), 10, 1, every, times=2, least=20)
    told = [r for r in wide.stats.collect()]
    assert len(told) == 120 and {r["survivors"] for r in told} == {10} and len({r["widenings"] for r in told}) > 1
    assert all(r["fetch_k"] == 2400 * r["probes"] // 64 + (2400 * r["probes"] % 64 > 0) and r["probes"] == 1 << r["widenings"] for r in told if r["probes"] < 64)
    narrow = vector_index.search(index, asked(v), 20, 1, few)
    assert ranking(narrow.ranking) == ranking(retrieval.dense(v, asked(v), 20, few))
    assert all(r["short"] and r["survivors"] == 12 and r["fetch_k"] == 2400 and r["widenings"] > 0 for r in narrow.stats.collect())


def test_filtered_results_pass_the_filter_and_are_in_order(spark):
    v = frame(spark, clustered(600))
    index = vector_index.store(v, new_path(spark, "t"), cells=40)
    got = ranking(vector_index.search(index, asked(v), 4, 2, v.where("vec_id % 2 = 1").select("vec_id")).ranking)
    assert len(got) == 30 * 4 and all(i % 2 for i, _ in got.values())
    assert all(got[q, r][1] >= got[q, r + 1][1] for q, r in got if r < 4)


def test_fresh_and_stale(spark):
    rows = clustered(200)
    path = new_path(spark, "t")
    assert vector_index.open_index(spark, path) is None
    vector_index.store(frame(spark, rows), path, model="m")
    assert vector_index.open_index(spark, path, frame(spark, list(reversed(rows))), "m").meta["cells"] == 14
    assert vector_index.open_index(spark, path, frame(spark, rows), "other") is None
    edited = [(i, [x + 1 for x in e]) if i == 7 else (i, e) for i, e in rows]
    assert vector_index.open_index(spark, path, frame(spark, edited), "m") is None


def test_nothing_and_little(spark):
    none = vector_index.store(frame(spark, []), new_path(spark, "t"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id bigint, query array<float>")
    found = vector_index.search(none, q)
    assert found.ranking.collect() == [] and {r["short"] for r in found.stats.collect()} == {True}
    one = vector_index.store(frame(spark, [(5, [0.5, 0.5]), (6, [0.5, 0.5])]), new_path(spark, "t"))
    assert vector_index.probes_for(one) >= 1
    assert ranking(vector_index.search(one, q, 5, 1).ranking) == {(1, 1): (5, 0.5), (1, 2): (6, 0.5)}


@pytest.mark.parametrize("cells", [1, 7, 20])
def test_cells_are_all_used(cells):
    rng = random.Random(cells)
    rows = np.array([[rng.choice([0.0, 1.0]), rng.random()] for _ in range(60)])
    centroids = vector_index.k_means(rows, cells, 6, 3)
    assert centroids.shape == (cells, 2) and np.isfinite(centroids).all()


def test_bitmaps_hold_ids_and_filter_without_a_shuffle(spark):
    from lakelens.operators import idsets

    wanted = [-70_000, -32_768, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 100_000, 2**40]
    ids = idsets.gathered(spark.createDataFrame([(i,) for i in [*wanted, 7, None]], "id bigint"), "id")
    others = [-2, 2, 9, 16, 40_000, 99_999, 2**40 + 1, 2**41, None]
    rows = spark.createDataFrame([(i, "x") for i in [*wanted, *others, 8]], "id bigint, bits string").repartition(3)
    got = idsets.members(rows, "id", ids)
    assert ids.n == len(wanted) and sorted(r["id"] for r in got.collect()) == sorted([*wanted, 8]) and got.columns == ["id", "bits"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    odd = idsets.gathered(spark.range(-200, 100_000).where("id % 2 = 1"), "id")
    three = idsets.gathered(spark.range(0, 50_000).where("id % 3 = 0"), "id")
    both = idsets.intersected(odd, three)
    assert both.n == len([i for i in range(50_000) if i % 2 and i % 3 == 0])
    assert idsets.members(spark.range(30), "id", both).count() == 5
    assert idsets.members(rows, "id", idsets.gathered(rows.where("false"), "id")).count() == 0


def test_cells_of_queries_stay_in_tasks(spark, monkeypatch):
    sent, block_of = [], vector_index.scan.block_of
    monkeypatch.setattr(vector_index.scan, "block_of", lambda q, *more: (sent.append(more), block_of(q, *more))[1])
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id bigint, embedding array<double>")
    index = vector_index.store(v, new_path(spark, "t"), cells=20)
    q = v.where("vec_id < 5").toDF("query_id", "query").unionByName(spark.createDataFrame([(900, [1.0] * 9)], "query_id bigint, query array<double>"))
    found = vector_index.search(index, q, 3, 4)
    assert {r["query_id"] for r in found.ranking.collect()} == set(range(5)) and sent and not any(sent)


def test_scores_at_once_are_few():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["vec_id"])
    assert max(len(p) for p in vector_index.scan.pieces(batch, 5000)) * 5000 <= 1 << 18 and vector_index.scan.BLOCK_BYTES <= 8 << 20
