import random
import re

from lakelens.llm import ngram_jaccard
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, cls string, component bigint"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in docs]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def near_copies(rng, n_base=12, n=260):
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(90)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    bases = [text(rng.choice([1, 2, 3, 5, 12, 40, 41, 120, 400])) for _ in range(n_base)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.85 else text(rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            if w:
                at = rng.randrange(len(w))
                w[at : at + 1] = [rng.choice(words)] * rng.choice([0, 1, 1, 2])
        docs.append((i, "  ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 7) for d, t in docs], SCHEMA).repartition(3)


def got(spark, docs, **p):
    return sorted(tuple(r) for r in ngram_jaccard.jaccard_components(frame(spark, docs), **p).collect())


def test_against_brute_force(spark, monkeypatch):
    docs = near_copies(random.Random(1))
    assert got(spark, docs) == brute(docs, 3, 90, 100)
    assert got(spark, docs, size=5, num=80, den=100) == brute(docs, 5, 80, 100)


def test_families_of_several_blocks():
    rng = random.Random(2)
    docs = near_copies(rng, 3, 120)
    sets = [s for s in ngram_jaccard.shingle_sets([t.encode() for _, t in docs], 3) if len(s)]
    sides = [rng.randrange(2) for _ in sets]
    py = [frozenset(s.tolist()) for s in sets]
    for across in (False, True):
        least = ngram_jaccard.linked(sets, sides, across, 90, 100)
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(py[i] & py[j]) >= 90 * len(py[i] | py[j]) and not (across and sides[i] == sides[j]):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        first = {}
        for i, x in enumerate(up):
            first.setdefault(x, i)
        assert [first[x] for x in up] == least


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 6)
    docs = near_copies(random.Random(3), 2, 150)
    assert got(spark, docs) == brute(docs, 3, 90, 100)


def test_linked_sets_always_share_a_part():
    import numpy as np

    rng = np.random.default_rng(4)
    for num in (80, 90):
        for n in [1, 2, 5, 9, 10, 11, 19, 20, 21, 50, 99, 300, 1000]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                lost = (100 - num) * len(a) // 100
                b = np.sort(a[lost:])
                new = (100 * len(b) - num * len(a)) // num
                b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, max(new, 0), dtype=np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                    x, y = (set(ngram_jaccard.part_digests(s, num, 100).tolist()) for s in (a, b))
                    assert x & y


def test_edges(spark):
    docs = [(3, None), (2, ""), (1, " \t"), (9, "a b"), (8, "A  b"), (7, "a"), (5, "a b c"), (6, "c " * 30_000), (4, "c " * 29_999)]
    assert got(spark, docs) == brute(docs, 3, 90, 100)
    assert got(spark, []) == []
    rows = got(spark, [(1, "x y z"), (1, "x y z"), (1, "other words here"), (2, "x y z")])
    assert sorted(r[2] for r in rows) == [1, 1, 1, 1]


def test_one_of_each(spark):
    docs = near_copies(random.Random(5), 8, 120)
    want = {c for _, n, c in brute(docs, 5, 80, 100) if n} | {d for d, n, _ in brute(docs, 5, 80, 100) if not n}
    kept = ngram_jaccard.one_of_each(frame(spark, docs), size=5, num=80, den=100)
    assert kept.columns == ["doc_id", "text", "cls", "component"]
    assert {r["doc_id"] for r in kept.collect()} == want
    rows = [(None, "one two three four five six", "", 1), (None, "one two three four five six", "", 1), (None, "quite another text of some words", "", 1), (4, "one two three four five six", "", 1), (4, "one two three four five six", "", 1)]
    kept = ngram_jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA), size=5, num=80, den=100)
    assert sorted((r["doc_id"] or 0, r["text"][:3]) for r in kept.select("doc_id", "text").collect()) == [(0, "qui"), (4, "one")]
    assert kept.where(F.col("text").isNull()).count() == 0


def test_sketches_never_part_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for num in (80, 90):
        sets = []
        for n in (3, 40, 255, 256, 257, 500, 513, 2000):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for _ in range(8):
                drop = rng.integers(0, max(1, n // 5) + 1)
                sets.append(np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64)])))
        sizes, sides = np.array([len(s) for s in sets]), rng.integers(0, 2, len(sets))
        for across in (False, True):
            least = ngram_jaccard.sketch_linked(sizes, [ngram_jaccard.sketch(s) for s in sets], sides, across, num, 100)
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    if 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)) and not (across and sides[i] == sides[j]):
                        assert least[i] == least[j]
            assert len(set(least)) >= 8


def test_words_of_one_polynomial_hash_stay_apart(spark):
    for n in (64, 1024, 2048):
        t = "".join("ab"[i.bit_count() & 1] for i in range(n))
        u = t.translate(str.maketrans("ab", "ba"))
        docs = [(1, t), (2, u), (3, f"{t} x y z"), (4, f"{u} x y z"), (5, t)]
        assert got(spark, docs) == brute(docs, 3, 90, 100)


def test_prefixes_never_part_a_link(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    steps = rng.integers(0, 4, 1 << 16).astype(np.uint8)  # any order will do
    loads = ngram_jaccard.Loads(16, steps)
    for num in (80, 90, 100):
        sets = []
        for n in (1, 2, 3, 9, 10, 11, 40, 333):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for _ in range(6):
                drop = rng.integers(0, max(1, n // 5) + 1)
                sets.append(np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64)])))
        sets = [s for s in sets if len(s)]
        for i, a in enumerate(sets):
            assert len(loads.prefix(a, num, 100)) == len(a) - -(-num * len(a) // 100) + 1 or len(a) == 1
            for b in sets[:i]:
                if 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                    assert len(np.intersect1d(loads.prefix(a, num, 100), loads.prefix(b, num, 100)))


def test_loads_count_every_set(spark):
    import numpy as np

    docs = near_copies(random.Random(7), 6, 80)
    sets = list(ngram_jaccard.shingle_sets([t.encode() for _, t in docs], 3))
    loads = ngram_jaccard.shingle_loads(frame(spark, docs), 3, sum(len(s) for s in sets))
    want = np.zeros(1 << loads.bits, np.int64)
    for s in sets:
        np.add.at(want, (s & np.uint64((1 << loads.bits) - 1)).astype(np.int64), 1)
    assert np.array_equal(loads.steps, np.minimum(np.round(8 * np.log2(1 + want)), 255).astype(np.uint8))


def test_rows_of_one_id_and_long_shingles(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(30):  # many texts, and copies of some, under one null id; and one id with two texts
        base = rng.choices(words, k=60)
        docs += [(None, " ".join(base)), (None, " ".join(base)), (None, " ".join([*base, "more"]))]
    docs += [(5, "a b c d e f g h"), (5, "other words stand in this one here"), (6, "a b c d e f g h"), (7, "other words stand in this one here")]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(docs) and {r["component_id"] for r in got if r["doc_id"] is not None} == {5}
    kept = ngram_jaccard.one_of_each(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), size=3).count()
    assert kept == 30 + 2
    far = [(i, " ".join(words[j] for j in range(s, s + 40))) for i, s in enumerate((0, 1, 100, 101, 200))]
    found = ngram_jaccard.jaccard_components(spark.createDataFrame(far, "doc_id bigint, text string"), size=8, num=90, den=100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(d, c) for d, _, c in brute(far, 8, 90, 100)]
