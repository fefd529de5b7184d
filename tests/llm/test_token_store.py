import random
import zlib

import numpy as np
import pytest
from lakelens.llm import token_counts, token_store
from lakelens.llm.tokens import PieceEncoder, default_tokenizer


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def twins(n=1024, letters="ab"):
    """Two strings that polynomial hashes modulo 2 ** 64 can't tell apart, whatever their multiplier."""
    t = "".join(letters[i.bit_count() & 1] for i in range(n))
    return t, "".join(letters[1 - (i.bit_count() & 1)] for i in range(n))


def test_pieces_of_one_hash_stay_apart(spark):
    import pyarrow as pa

    ids = plain()
    for letters in ("ab", "ae"):
        t, u = twins(letters=letters)
        texts = [t, u, "x " + u, "y " + t, "x " + t + " " + u, u, t, f"{u} {u} {t}"]
        enc = PieceEncoder(default_tokenizer())
        for _ in range(2):
            assert [list(x) for x in enc.encode(pa.array(texts, pa.string()))] == [ids(x) for x in texts]
        got = {r["doc_id"]: r for r in token_store.token_store(table(spark, texts)).collect()}
        assert [got[i * 3]["ids_crc32"] for i in range(len(texts))] == [zlib.crc32(np.array([*ids(x), 2], "<u4").tobytes()) for x in texts]
        lens = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_lengths(table(spark, texts)).collect()}
        assert [lens[i * 3] for i in range(len(texts))] == [len(ids(x)) for x in texts]


def some_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeèñß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    odd = ["", None, " ", "  ", "a  b", " a b ", "x \n y", "a\x1cb c", "<|endoftext|> hi", "a <|endoftext|> b", "a x<|endoftext|>y b<|endoftext|>", "é   b", "don't 's x", "\t a", "12 !! ??", "日本 語", "\n"]
    return base + odd + base[:20] + [" ".join(words * 60)] * 3


SCHEMA = "doc_id bigint, text string, extra int, start string"


def table(spark, texts):
    return spark.createDataFrame([(i * 3, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)


def test_pieces_encode_as_whole_texts():
    import pyarrow as pa

    enc, ids = PieceEncoder(default_tokenizer(), most=50), plain()
    texts = some_texts()
    for _ in range(2):
        assert [list(x) for x in enc.encode(pa.array(texts, pa.string()))] == [ids(t) for t in texts]
    assert enc.counts(pa.array(texts, pa.string())).tolist() == [len(ids(t)) for t in texts]


def test_store_gives_back_every_id(spark):
    texts, ids = some_texts(), plain()
    path = token_store.write_store(table(spark, texts))
    got = {r["doc_id"]: r for r in token_store.read_summary(spark, path).collect()}
    whole = {r["doc_id"]: r for r in token_store.read_documents(spark, path).collect()}
    start = 0
    for i, t in enumerate(texts):
        want = [*ids(t), 2]
        r = got[i * 3]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert list(whole[i * 3]["ids"]) == want and whole[i * 3]["start"] == start
        start += len(want)
    assert len(got) == len(texts)
    hashes = [h for r in spark.read.parquet(f"{path}/packs").collect() for h in [bytes(r["hashes"])[i : i + 16] for i in range(0, len(r["hashes"]), 16)]]
    assert len(hashes) == len(set(hashes))  # unique chunks are stored once
    assert len(hashes) < sum(r["n_chunks"] for r in got.values())


def test_store_notices_damage(spark):
    path = token_store.write_store(table(spark, some_texts()))
    packs = spark.read.parquet(f"{path}/packs")
    packs.limit(0).union(packs.selectExpr("bucket", "hashes", "sizes", "reverse(root) as root", "payload")).write.parquet(f"{path}-bad/packs")
    for t in ("recipes", "parts", "store"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{path}-bad/{t}")
    with pytest.raises(Exception, match="Merkle"):
        token_store.read_summary(spark, f"{path}-bad").collect()
    # A lost recipe, a changed part.
    for name, change in (("recipes", lambda df: df.where("place <> 1")), ("parts", lambda df: df.selectExpr("part", "base", "n_docs + 1 as n_docs", "n_tokens", "reverse(digest) as digest"))):
        for t in ("packs", "recipes", "parts", "store"):
            df = spark.read.parquet(f"{path}/{t}")
            (change(df) if t == name else df).write.parquet(f"{path}-{name}/{t}")
        with pytest.raises(ValueError, match="digests|Merkle"):
            token_store.read_summary(spark, f"{path}-{name}").collect()
    assert token_store.verify_store(spark, path) == token_store.verify_store(spark, path)


def test_store_of_null_ids_repeats_and_nothing(spark):
    rows = [(None, "b", 1, "x"), (5, "same", 1, "x"), (5, "same", 1, "x"), (5, None, 1, "x")]
    got = [tuple(r)[:3] for r in token_store.token_store(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()]
    n = len(plain()("same")) + 1
    assert got[0] == (None, 0, len(plain()("b")) + 1)
    assert sorted(g[2] for g in got[1:]) == [1, n, n]
    assert token_store.token_store(spark.createDataFrame([], SCHEMA)).collect() == []


def test_joined_crc():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    cuts = [0, 0, 10, 4000, 5000]
    assert token_store.joined_crc([(zlib.crc32(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:], strict=False)]) == zlib.crc32(data)


def test_counts_against_brute_force(spark):
    texts, ids = some_texts(), plain()
    lens = [len(ids(t)) for t in texts]
    context = token_counts.token_counts(table(spark, texts)).cache()
    for r in context.collect():
        limit = r["context_limit"]
        assert r["n_docs"] == lens.count(limit)
        assert (r["docs_over"], r["docs_up_to"]) == (sum(x > limit for x in lens), sum(x <= limit for x in lens))
        assert (r["tokens_over"], r["tokens_up_to"]) == (sum(x for x in lens if x > limit), sum(x for x in lens if x <= limit))
        assert r["tokens_truncated"] == sum(min(x, limit) for x in lens)
    assert {r["context_limit"] for r in context.collect()} == set(lens)
    s = sorted(lens)
    for p, n in token_counts.quantiles(context, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        assert n == s[max(0, int(np.ceil(p * len(s))) - 1)]
    limits = spark.createDataFrame([(0,), (7,), (300,), (10**6,)], "limit bigint")
    assert {r["limit"]: r["tokens"] for r in token_counts.truncated_totals(context, limits).collect()} == {k: sum(min(x, k) for x in lens) for k in (0, 7, 300, 10**6)}
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []
