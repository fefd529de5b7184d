import hashlib
import random
import zlib

from lakelens.llm import merkle
from lakelens.llm.queries import op13_merkle_manifest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, idx int, size int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*[value(v) for v in (d[0], d[3], d[2], d[4], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    """(place, siblings) for each level."""
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def plain(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(groups[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1]))) for s in names}
    trees = {s: levels([leaf(d, d[1]) for d in order[s]]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    root, out = over[-1][0] if names else None, []
    for j, s in enumerate(names):
        for i, d in enumerate(order[s]):
            steps = path(trees[s], i) + path(over, j)
            low = None if d[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1])
            now = leaf(d, low if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 else d[1])
            for at, siblings in steps:
                now = h(*siblings[:at], now, *siblings[at:])
            out.append((d[0], leaf(d, d[1]), trees[s][-1][0], root, h(*[x for _, siblings in steps for x in siblings]), now, now == root))
    return out


def check(spark, tmp_path, docs, name):
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = op13_merkle_manifest(spark, f"{tmp_path}/{name}").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(docs), key=str)
    return got


def made(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["Some Text", "plain", "", None, "É ÀB\n"]) if i % 3 else f"T {i}", rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 5, i]), "x", 1, 2) for i in range(n)]


def test_small_tables_equal_plain_trees(spark, tmp_path):
    docs = made(60, ["b", "a", None, "", "é", "z"]) + [(7, "Same", "en", "a", 4, "x", 1, 2)] * 3 + [(None, "Null Id", None, "b", 1, "x", 1, 2), (99, "W " * 200_000, "en", "long", 400_000, "x", 1, 2)]
    got = check(spark, tmp_path, docs, "small")
    assert {r["verified"] for r in got} == {True, False}
    check(spark, tmp_path, made(1, ["a"]), "one")
    check(spark, tmp_path, made(16, ["a"]) + made(17, ["b"]), "edges")
    assert check(spark, tmp_path, [], "none") == []


def test_large_tree_and_many_sources(spark, tmp_path):
    docs = made(4200, ["hot"], 2) + [(10_000 + i, f"Doc {i}", "en", f"s{i}", i, "x", 1, 2) for i in range(300)]
    check(spark, tmp_path, docs, "large")


def test_frontiers_meet_wherever_leaves_lie(spark):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(700)]
    rows = spark.createDataFrame([("t", 700, 0, i, d) for i, d in enumerate(digests)], "tree string, size bigint, level int, idx bigint, digest binary")
    nodes = merkle._combined(rows.repartition(9, F.hash("idx")))
    rounds = 0
    while (pending := nodes.where(F.col("kind") == merkle.PENDING)).count():
        rounds += 1
        nodes = merkle._combined(pending.repartition(4, "tree", merkle._block(merkle.STEP * rounds)))
    top = nodes.where(F.col("kind") == merkle.TOP).collect()
    assert [bytes(t["digest"]).hex() for t in top] == levels([d.hex() for d in digests])[-1] and rounds == 2


def test_fold_proves_and_refutes():
    run = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    root = merkle.hash_of(b"".join(run))
    shape, siblings = bytes([2, 4]), b"".join(run[:2] + run[3:])
    assert merkle.fold(run[2], shape, siblings) == root and merkle.fold(run[1], shape, siblings) != root
