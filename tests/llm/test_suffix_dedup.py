import hashlib
import random

from lakelens.llm import suffix_dedup
from lakelens.llm.suffix_dedup import LEAST

SCHEMA = "doc_id bigint, text string, bucket string, row int"


def brute(docs):
    """docs: (doc_id, text). Results by the definition."""
    data = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, b in data:
        for i in range(len(b) - LEAST + 1):
            w = b[i : i + LEAST]
            if w not in first or key(d) < first[w]:
                first[w] = key(d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - LEAST + 1):
            if first[b[i : i + LEAST]] < key(d):
                gone[i : i + LEAST] = b"\1" * LEAST
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, docs):
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([(d, t, "b", 1) for d, t in docs], SCHEMA).repartition(4))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(brute(docs), key=order)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(8, 60)) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 40)) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3 and parts:  # a cut passage
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts.append(p[a : a + rng.randint(0, len(p))])
        docs.append((i, " ".join(parts)))
    docs += [(200 + i, docs[i % 7][1]) for i in range(20)]
    check(spark, docs)


def test_low_entropy_and_edges(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(60)]
    docs += [(100 + i, "a" * n) for i, n in enumerate([0, 49, 50, 51, 99, 200, 300])]
    docs += [(200, "xy" * 60), (201, "yx" * 60), (202, "x" + "yx" * 30), (203, None), (204, "ab" * 300 + "c")]
    check(spark, docs)


def test_repeated_ids_nulls_and_nothing(spark):
    p, q = "the same long passage of words that is over fifty bytes long", "another passage, also of more than fifty bytes, that repeats"
    check(spark, [(1, p), (1, p), (1, p + q), (None, p), (None, q), (0, q), (5, p + q)])
    check(spark, [])


def test_texts_longer_than_a_run(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long = text(1000)
    docs = [(2, long), (1, text(500) + long[1000:3000] + text(100)), (3, long[500:900] + "!"), (4, text(5))]
    monkeypatch.setattr(suffix_dedup, "RUN", 700)
    got = [list(x) for x in suffix_dedup.contexts([t.encode() for _, t in docs])]
    whole = {}
    for i, starts, ends, _ in got:
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            assert LEAST <= z - a <= 2 * LEAST
            whole.setdefault(i, []).extend(range(a, z - LEAST + 1))
    assert {i: sorted(x) for i, x in whole.items()} == {i: list(range(max(0, len(t.encode()) - LEAST + 1))) for i, (_, t) in enumerate(docs) if len(t) >= LEAST}
    monkeypatch.undo()
    check(spark, [(d, t * 1) for d, t in docs])


def test_maximal_repeats_have_all_occurrences():
    import numpy as np

    core = bytes(range(60, 60 + 55))
    strings = [b"x" + core + b"1", b"y" + core + b"2", b"z" + core[:52] + b"???", b"y" + core[:51] + b"!!!!"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    lens = np.array([len(s) for s in strings])
    got = {(n, least, tuple(sorted(p))) for n, least, p in suffix_dedup.maximal_repeats(data, np.cumsum(lens) - lens, lens, np.array([4, 3, 2, 9]))}
    assert (55, 3, ((0, 1), (1, 1))) in got
    assert (52, 2, ((0, 1), (1, 1), (2, 1))) in got
    assert (51, 2, ((0, 1), (1, 1), (2, 1), (3, 1))) in got
    assert (52, 3, ((1, 0), (3, 0))) in got


def test_equal_hashes_do_not_make_equal_bytes(spark, monkeypatch):
    """With a hash that tells nothing apart, results stay those of the bytes."""
    import numpy as np

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(70) for _ in range(4)]
    strings = [(text(5) + rng.choice(shared)[rng.randint(0, 10) :])[:82].encode() for _ in range(30)]
    strings = sorted(set(strings))
    data, lens = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    low = np.arange(len(strings))
    want = sorted((n, least, sorted(p)) for n, least, p in suffix_dedup.maximal_repeats(data, np.cumsum(lens) - lens, lens, low))
    monkeypatch.setattr(suffix_dedup, "_hash_of", lambda sums, down, starts, ends: np.zeros(len(starts), np.uint64))
    assert want and sorted((n, least, sorted(p)) for n, least, p in suffix_dedup.maximal_repeats(data, np.cumsum(lens) - lens, lens, low)) == want


def test_strings_that_hashes_cannot_tell_apart(spark):
    t = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    u = t.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, t), (2, u), (3, "x" + u), (4, t[:1024]), (5, u[:1024])])


def test_repeat_groups_name_every_occurrence(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    p, q = text(60), text(55)
    docs = [(1, text(30) + p + text(20)), (2, p), (3, text(9) + p + q), (4, q + text(40)), (4, q), (5, text(200)), (None, q)]
    rows = suffix_dedup.repeat_groups(spark.createDataFrame([(d, t, "b", 1) for d, t in docs], SCHEMA).repartition(3)).collect()
    data = [(d, t.encode()) for d, t in docs]
    want, covered = {}, {}
    for d, b in data:  # every window that documents of several ids hold, and where
        for i in range(len(b) - LEAST + 1):
            want.setdefault(b[i : i + LEAST], set()).add((d, i))
    want = {w: at for w, at in want.items() if len({d for d, _ in at}) > 1}
    for r in rows:
        [whole] = {b[r["start"] : r["start"] + r["length"]] for d, b in data if d == r["doc_id"] and hashlib.sha256(b[r["start"] : r["start"] + r["length"]]).hexdigest() == r["repeat"]}
        for i in range(r["length"] - LEAST + 1):
            covered.setdefault(whole[i : i + LEAST], set()).add((r["doc_id"], r["start"] + i))
    assert covered == want
