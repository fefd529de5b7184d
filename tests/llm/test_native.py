import hashlib
import math
import random
import re
from collections import Counter

import pytest
from lakelens.llm import chat_format, decontaminate, exact_dedup, mixing
from pyspark.sql import functions as F

DOC = "doc_id bigint, text string, source string, hashes int, norm string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "n") for d, t, s in rows], DOC).repartition(3)


# ---- chat formatting

CHAT = "conv_id bigint, turn bigint, role string, text string, turns int"


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<", "|", "\\", "<|im_end|>", "<|im_start|>assistant\n", "<|im_sep|>", "\n", "é", "<\\|", "<\\\\|im_end|>", "%", " ok"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", "", None, "a%0Ab\n<|im_sep|>"])
            rows.append((c, t, role, None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))))
    rows += [(100, None, "user", "first"), (100, 1, "user", "second"), (100, 1, "user", "second"), (None, 3, "assistant", "x")]
    got = chat_format.parse_chat(chat_format.format_chat(spark.createDataFrame([(*r, 5) for r in rows], CHAT).repartition(3)))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in got.collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss_texts"] == [x for role, x in want[r["conv_id"]] if role == "assistant"]
        assert r["formatted"].count("<|im_start|>") == sum(1 for i, (role, _) in enumerate(want[r["conv_id"]]) if i == 0 or want[r["conv_id"]][i - 1][0] != role)
    assert got.count() == len(want)
    assert chat_format.format_chat(spark.createDataFrame([], CHAT)).collect() == []


# ---- exact dedup


def test_chat_with_long_texts(spark):
    long = "<|im_end|>é " * 100_000
    rows = [(1, 0, "user", long, 5), (1, 1, "assistant", long, 5), (1, 2, "assistant", None, 5)]
    [r] = chat_format.parse_chat(chat_format.format_chat(spark.createDataFrame(rows, CHAT))).collect()
    assert [tuple(t) for t in r["turns"]] == [("user", long), ("assistant", long), ("assistant", "")] and "".join(r["loss_texts"]) == long


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, (d, t, _) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for i, (d, t, _) in enumerate(rows):
        g = groups[norm(t)]
        out.append((d, rows[min(g)[3]][0], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "ab", "a b", " a\tb\n", "x" * 50_000, "x" * 50_000 + " ", "", " ", None, "c\x0bd", f"u{i % 30}"]), "s") for i in range(300)]
    rows += [(7, "a b", "s"), (7, "a b", "s"), (None, "only null", "s"), (None, "q", "s"), (400, "q", "s")]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    want, n_groups = brute_dedup(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == n_groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


# ---- decontamination


def words(t):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def grams(w, k=5):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])


def brute_hits(rows, items):
    out = {}
    for d, t, _ in rows:
        s = grams(words(t))
        for i, text in items:
            g = grams(words(text))
            c, n = Counter(g), len(g)
            for a in range(-n + 1, len(s)):
                w = s[max(a, 0) : max(a + n, 0)]
                m = sum((Counter(w) & c).values())
                if n and m and m / (len(w) + n - m) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), m / (len(w) + n - m))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 6, 15, 30, 60]))) for i in range(14)] + [(90, ""), (91, None), (92, "one two"), (93, "a b a b a b a b a b a b")]
    rows = []
    for d in range(120):
        parts = [text(rng.randint(0, 40))]
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + 1] = [rng.choice(vocab)] * rng.choice([0, 1, 2])
            if rng.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            parts.append(", ".join(w).upper())
        parts.append(text(rng.randint(0, 40)))
        rows.append((d, "*** ".join(parts), "s"))
    rows += [(500, "One, two!", "s"), (501, None, "s"), (502, "", "s"), (None, items[5][1], "s"), (503, "a b " * 9, "s")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    want = brute_hits(rows, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    kept = decontaminate.decontaminate(docs(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "source", "hashes", "norm"]
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(docs(spark, []), bench).collect() == []


def test_multi_index_finds_all_within_the_radius(spark):
    rng = random.Random(4)
    a = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    b = []
    for x in a:
        for bit in rng.sample(range(63), rng.randint(0, 19)):
            x ^= 1 << bit
        b.append(x)
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a bigint, b bigint")
    shared = F.arrays_overlap(decontaminate.blocks(F.col("a")), decontaminate.near_blocks(F.col("b"), 19))
    assert df.where(~shared).count() == 0


def near_items(rng, n):
    """Items of words of their own, and copies of which every text lacks some, beside other words."""
    items, rows = [], []
    for i in range(n):
        w = [f"w{i}x{j}" for j in range(rng.randint(15, 60))]
        items.append((i, " ".join(w)))
        for k in range(3):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 1])):
                v[rng.randrange(len(v))] = f"other{rng.randrange(10**9)}"
            side = lambda: " ".join(f"s{rng.randrange(10**9)}" for _ in range(rng.randint(5, 30)))
            rows.append((3 * i + k, f"{side()} {' '.join(v)} {side()}", "s"))
    return items, rows


def test_recall_of_fingerprints_alone(spark, monkeypatch):
    """Every place of every document as a window: the fingerprints find what brute force finds, and so do they behind the
    choice of windows."""
    items, rows = near_items(random.Random(11), 60)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set(brute_hits(rows, items))
    screened = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}

    def everywhere(d, its, size):
        lengths = F.array(*[F.lit(r["c"]) for r in its.select("c").distinct().collect()])
        n = d.select("doc_id", F.size(decontaminate.words(F.col("text"))).alias("n")).where("n > 0")
        return n.select("doc_id", F.explode(lengths).alias("c"), F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0))).alias("places"))

    monkeypatch.setattr(decontaminate, "places_of_item_shingles", everywhere)
    unscreened = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert len(want) > 90 and screened == unscreened and screened <= want
    assert len(screened) >= 0.98 * len(want)


def test_decontamination_of_repeats_and_nothing(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id bigint, text string")
    rows = [(7, "clean", "s"), (7, f"a {item} b", "s"), (7, f"a {item} b", "s"), (None, item, "s"), (8, ("word " * 30_000) + item, "s")]
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (7, 8, None) for i in (1, 2, None)], key=str)
    assert decontaminate.decontaminate(docs(spark, rows), bench).collect() == []
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs(spark, rows), nothing).collect() == []
    assert decontaminate.decontaminate(docs(spark, rows), nothing).count() == len(rows)


# ---- mixing


def brute_copies(doc_id, rate):
    u = (int(hashlib.md5(f"mix-1|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf < u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_mixing_against_brute_force(spark):
    rows = [(i, "x" * (1 + i % 5), "big") for i in range(400)] + [(1000 + i, "yy", "small") for i in range(20)] + [(2000, "zzz", None), (2001, None, "empty"), (None, "w", "big"), (3, "xxxx", "big")]
    got = mixing.mix(docs(spark, rows), weights={"big": 1.0, "small": 3.0, None: 0.5})
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    share = {"big": 1.0, "small": 3.0, None: 0.5}
    rate = {s: share.get(s, 0) / 4.5 * sum(size.values()) / size[s] if size[s] else 0 for s in size}
    want = Counter()
    for d, t, s in rows:
        want[d, t] += brute_copies(d, rate[s]) if rate[s] else 0
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +want
    clash = spark.createDataFrame([(1, "x" * 70_000, "s", 9, 8, 7)], "doc_id bigint, text string, source string, mix_copy int, cdf int, row int")
    named = mixing.mix(clash, weights={"s": 1.0}, total=400_000.0)
    assert named.columns == [*clash.columns, "mix_copy_", "mix_key"] and {tuple(r)[:6] for r in named.collect()} == {(1, "x" * 70_000, "s", 9, 8, 7)}
    assert {tuple(r) for r in mixing.mixed_rows(clash, weights={"s": 1.0}, total=400_000.0).collect()} == {(1, "x" * 70_000, "s", 9, 8, 7)}
    keys = [r["mix_key"] for r in got.collect()]
    assert keys == sorted(keys)
    assert mixing.mix(docs(spark, [])).collect() == []
    by = {r["of"]: r["cdf"] for r in mixing.poisson_thresholds(spark.createDataFrame([("a", 300.0), (None, 0.0), ("b", 20_000.0)], "of string, rate double")).collect()}
    thresholds = by["a"]
    assert by[None] == [1.0] and abs(sum(1 - c for c in by["b"]) - 20_000) < 1e-4
    assert abs(thresholds[-1] - 1) < 1e-9 and abs(sum(1 - c for c in thresholds) - 300) < 1e-6


def test_decontamination_at_edges(spark):
    from lakelens.llm import decontaminate

    # Items of five shingles and texts that lack the last word, so of similarity 0.8; these six of 20,000 differ in over 23 bits.
    run = lambda i, n: " ".join(f"w{i}x{j}" for j in range(1, n + 1))
    ids = [720, 4204, 7486, 11392, 15963, 19915]
    bench = spark.createDataFrame([(i, run(i, 9)) for i in ids], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, run(i, 8)) for i in ids], "doc_id bigint, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in found) == [(i, i, 0.8) for i in ids]
