"""Pair search, lexical search and chunks against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakelens.functions import text as tx
from lakelens.functions.stem import porter
from lakelens.functions.text import STOP_WORDS
from lakelens.operators import chunking, lexicon, quantiles, runs, similarity
from lakelens.storage import set_conf


def sets(rng, n, vocabulary, most):
    out = {}
    for i in range(n):
        base = rng.sample(vocabulary, rng.randint(0, most)) if i < 5 or rng.random() < 0.5 else list(out[rng.randrange(i)])
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if base:
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        out[i] = sorted(set(base))
    return out


def close(a, b, t):
    n = len(set(a) & set(b))
    return n / len(set(a) | set(b)) if n and n / len(set(a) | set(b)) >= t else None


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 1.0])
def test_pairs_within_one_side(spark, t):
    rng = random.Random(int(t * 10))
    held = sets(rng, 90, [f"w{i}" for i in range(120)], 60)
    want = {(a, b): s for a in held for b in held if a < b and (s := close(held[a], held[b], t)) is not None}
    df = spark.createDataFrame(list(held.items()), "id bigint, items array<string>").repartition(3)
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.jaccard_pairs(df, None, t).collect()}
    assert want and got == pytest.approx(want)


def test_pairs_of_two_sides_and_nothing(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    a, b = sets(rng, 40, vocabulary, 30), {i: s for i, s in sets(rng, 50, vocabulary, 50).items()}
    b |= {100 + i: s for i, s in list(a.items())[:10]}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id bigint, items array<string>").repartition(3)
    want = {(x, y): s for x in a for y in b if (s := close(a[x], b[y], 0.45)) is not None}
    assert want and {(r["a"], r["b"]): r["similarity"] for r in similarity.jaccard_pairs(frame(a), frame(b), 0.45).collect()} == pytest.approx(want)
    none = spark.createDataFrame([], "id bigint, items array<string>")
    assert similarity.jaccard_pairs(none, None, 0.5).collect() == [] and similarity.jaccard_pairs(none, frame(b), 0.5).collect() == []


@pytest.mark.parametrize("t", [0.3, 0.45, 0.8, 1.0])
def test_a_small_left_side_goes_to_the_right(spark, monkeypatch, t):
    """Nothing of the right side travels, and the pairs are those of the join by buckets."""
    rng = random.Random(int(t * 100))
    vocabulary = [f"w{i}" for i in range(90)]
    a, b = sets(rng, 40, vocabulary, 40), {100 + i: s for i, s in sets(rng, 400, [*vocabulary, *[f"x{i}" for i in range(60)]], 50).items()}
    b |= {600 + i: s for i, s in a.items()} | {700: [], 701: [f"z{i}" for i in range(3000)]}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id bigint, items array<string>").repartition(3)
    want = {(x, y): s for x in a for y in b if (s := close(a[x], b[y], t)) is not None}
    left, right = frame(a), similarity.materialize(frame(b), "right")
    for pairs in (similarity.PAIRS, 1):
        monkeypatch.setattr(similarity, "PAIRS", pairs)
        found = similarity.jaccard_pairs(left, right, t)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
        assert len(rows) == len(want) and {(r["a"], r["b"]): r["similarity"] for r in rows} == pytest.approx(want)
    monkeypatch.setattr(similarity, "HELD_ITEMS", 0)
    assert {(r["a"], r["b"]): r["similarity"] for r in similarity.jaccard_pairs(left, right, t).collect()} == pytest.approx(want)


def test_pairs_in_steps(spark, monkeypatch):
    """The same pairs when buckets, found pairs and comparisons all go in steps, and blocks and heads are of few sets and items."""
    rng = random.Random(9)
    held = sets(rng, 90, [f"w{i}" for i in range(120)], 60)
    want = {(a, b): s for a in held for b in held if a < b and (s := close(held[a], held[b], 0.5)) is not None}
    tags, written = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, tag, path=None: tags.append(tag) or written(df, tag, path))
    for name, value in (("BUCKETS", 6), ("BLOCK", 2), ("HEADS", 2), ("STEPS", 3), ("PAIRS", 64)):
        monkeypatch.setattr(similarity, name, value)
    monkeypatch.setattr(similarity, "_steps", lambda number, total, most: [(i, min(i + 2, number)) for i in range(0, number, 2)])
    df = spark.createDataFrame(list(held.items()), "id bigint, items array<string>")
    rows = similarity.jaccard_pairs(df, None, 0.5).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["similarity"] for r in rows} == pytest.approx(want)
    assert [tags.count(x) for x in ("met", "pairs")] == [3, 2] and tags.count("scored") > 1


def test_sets_travel_for_many_pairs_at_once(spark):
    """Of near copies, which all pair with each other, the shuffle takes the sets some times, not once for each pair."""
    copies = spark.range(100).select("id", F.expr("transform(sequence(0, 1999), i -> xxhash64(if(i < 40, id * 40 + i, 1000000 + i)))").alias("items"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    with set_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        before = shuffled()
        assert similarity.jaccard_pairs(copies, None, 0.5).count() == 4950
        assert shuffled() - before < 20 * 100 * 2000 * 8  # once for each pair would be 99 times as much as the sets


def test_trigram_codes_are_one_for_each_trigram(spark):
    texts = ["", None, "ab", "abc", "Abc  abc\tABC", "ééé\u00a0 \U0001f600\U0001f601\U0001f600\U0001f601", "naïve\x00 aaaa", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", tx.trigrams(F.col("text")).alias("t"), tx.trigram_codes(F.col("text")).alias("c")).collect()
    for x in rows:
        assert len(x["t"]) == len(x["c"]) == len(set(x["c"]))
        assert all(len(set(x["t"]) & set(y["t"])) == len(set(x["c"]) & set(y["c"])) for y in rows)


def test_wide_sets_meet_few(spark):
    """Sets of thousands of items, of which random ones share a third, are told apart before anything travels for a pair."""
    rng = random.Random(6)
    held = {i: sorted(rng.sample([f"w{j}" for j in range(9000)], 3000)) for i in range(30)}
    held[30] = held[0][:-200] + [f"x{j}" for j in range(200)]
    side = similarity._hashed(spark.createDataFrame(list(held.items()), "id bigint, items array<string>"))
    dealt = similarity._dealt(side, 0, 0.5, similarity._frequent([side], 31), 4).repartitionById(4, F.col("bucket"))
    assert {(min(r), max(r)) for r in similarity._met(dealt, 0.5, True).collect()} == {(0, 30)}


def test_sets_that_share_one_value_are_not_compared(spark):
    rows = [(k, v) for k in range(80) for v in (0, *range(10 * k + 1, 10 * k + 6))] + [(90, v) for v in range(6)] + [(91 + k, 10 * k + v) for k in range(80) for v in (1, 2, 9)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = similarity.set_overlaps(df, "k", "v", 3)
    assert [tuple(r) for r in got.collect()] == [(0, 90, 6)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") == similarity.LANES


def test_set_overlaps(spark):
    rng = random.Random(4)
    rows = [(k, v) for k in range(60) for v in rng.choices(range(25), k=rng.randint(1, 9))]
    held = {}
    for k, v in rows:
        held.setdefault(k, set()).add(v)
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= 3}
    got = similarity.set_overlaps(spark.createDataFrame(rows, "k int, v int"), "k", "v", 3).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_stemmed_search(spark, tmp_path):
    rng = random.Random(5)
    words = ["connect", "connected", "connecting", "relational", "relate", "the", "of", "lens", "lenses", "running", "runs", "sky"]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(40)} | {40: None}
    asked = {0: "connection of lenses", 1: "Relating skies", 2: "the of"}
    tokens = lambda t: [porter(w) for w in (t or "").lower().split() if w not in STOP_WORDS]
    held = {i: Counter(tokens(t)) for i, t in docs.items()}
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(w for c in held.values() for w in c)
    want = []
    for q, text in asked.items():
        scores = {}
        for i, c in held.items():
            s = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(tokens(text)) if c[w])
            if s:
                scores[i] = round(s, 6)
        want += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7])]
    frame = spark.createDataFrame(list(docs.items()), "id bigint, text string").repartition(3)
    index = lexicon.create(frame, "id", F.col("text"), str(tmp_path / "index"), stemmed=True)
    q = spark.createDataFrame(list(asked.items()), "query_id bigint, query string")
    found = lexicon.search(index, q, 7, stemmed=True).ranking
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found.collect()) == sorted(want)
    assert lexicon.open_lexicon(spark, str(tmp_path / "index"), True).meta == index.meta
    with pytest.raises(ValueError, match="stemmed"):
        lexicon.search(index, q, 7, stemmed=False)


def test_runs_are_greedy():
    rng = random.Random(6)
    for _ in range(500):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(0, 25))]
        limit, overlap = rng.randint(9, 25), rng.randint(0, 8)
        got = chunking.runs(sizes, limit, overlap)
        assert (not sizes and not got) or (got[0][0] == 0 and got[-1][1] == len(sizes))
        for a, z in got:
            assert sum(sizes[a:z]) <= limit and (z == len(sizes) or sum(sizes[a : z + 1]) > limit)
        for (a, z), (b, _) in zip(got, got[1:], strict=False):
            assert a < b <= z and sum(sizes[b:z]) <= overlap  # all parts are covered, an overlap is within its bound
            if b < z and b > a + 1:
                assert sum(sizes[b - 1 : z]) > overlap or sizes[b - 1] == 0
    assert chunking.runs([1, 1, 1, 1], 2) == [(0, 2), (2, 4)]


def test_chunks_of_a_long_paragraph():
    c = chunking.Chunker(target=40, cap=60, overlap=5, special=0)
    budget = 60 - 1 - 8
    words = [f"w{i}" for i in range(200)]
    out = c.chunks(" ".join(words), "h")
    assert [x.split()[0] for x in out] == ["w0", "w46", "w92", "w138", "w184"] and all(len(x.split()) <= budget for x in out)
    sentences = " ".join(f"a{i} b{i} c{i}." for i in range(40))
    cut = c.chunks(f"short one\n{sentences}\nlast", "h")
    assert cut[0] == "short one" and cut[-1] == "last" and {w for x in cut[1:-1] for w in x.split()} == set(sentences.split())
    assert all(x.endswith(".") and len(x.split()) <= budget for x in cut[1:-1])


def test_quantiles_of_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for _ in range(300)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(3)
    got = {r["k"]: (r["x"], r["y"]) for r in quantiles.quantiles(df, ["k"], F.col("v"), {"x": 0.5, "y": 0.9}).collect()}
    want = {r["k"]: (r["x"], r["y"]) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("x"), F.percentile("v", F.lit(0.9)).alias("y")).collect() if r["x"] is not None}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert quantiles.quantiles(df.where("false"), [], F.col("v"), {"x": 0.5}).collect() == []


def test_bank_report(spark, tmp_path):
    rows = [("r", "router", f"q{i}", "sql", "L1", "sql", "executed", i != 1, "" if i != 1 else "rows differ", 1, None, None, None, None, 0.5 * i, i) for i in range(3)]
    rows += [("r", "router", "q9", "vector", "L2", None, "error", None, "ValueError: x", 0, None, None, None, None, 1.0, 9)]
    text = runs.bank_report(spark.createDataFrame(rows, runs.RECORD), "Run r")
    assert "| router | 2 | 3 | 1 |" in text and "| router | rows differ | 1 | q1 |" in text and "| router | sql | sql | 3 |" in text
    assert runs.journal(spark, str(tmp_path / "none")).collect() == []
    m = spark.createDataFrame([("a", 1, 5, 1, 1.0, 1.0, 0.9), ("b", 1, 5, 1, 1.0, 0.5, 0.4), ("a", 2, 5, 0, 0.0, 0.0, 0.0), ("b", 2, 5, 0, 0.0, 0.0, 0.0)], "condition string, query_id int, k int, hit int, recall double, mrr double, ndcg double")
    assert "| a | b | 5 | 1 | 1 | 0 |" in runs.retrieval_report(m, "Retrieval")


def test_sections_come_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(i, "h", "report", "s", f"a {i}.\nb") for i in range(2 * chunking.CUT_ROWS + 1)]
    cut = chunking.chunk_table(spark.createDataFrame(rows, "project_id bigint, header string, source string, section string, text string").coalesce(1))
    assert cut.count() == len(rows) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
