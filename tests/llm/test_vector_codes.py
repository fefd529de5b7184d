import math
import random

import numpy as np
from lakelens.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, v int"


def rows_of(n, dims=8, seed=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)], rng.choice([0, 1, 1, None]), "x", 1) for i in range(n)]


def plain(rows, parts=4, entries=16, rounds=4):
    """Lloyd from the start in every round, over plain lists."""
    kept = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        at = [[best(p, x) for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, at, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, v, label in kept:
        code = [best(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, code, sum(far(x, books[p][c]) for (p, x), c in zip(enumerate(cut(v)), code, strict=True))))
    return out, books


def test_equals_plain_lloyd(spark):
    rows = rows_of(300)
    rows += [(7, rows[7][1], 5, "y", 2), (None, rows[3][1], None, "y", 2), (None, None, 1, "y", 2)]
    rows += [(400, [0.5] * 7 + [None], 1, "y", 2), (401, [float("nan")] + [0.0] * 7, 1, "y", 2), (402, [float("-inf")] + [0.0] * 7, 1, "y", 2), (403, None, 0, "y", 2)]
    got = vc.quantize(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=16)
    want, books = plain(rows)
    assert got.books.tolist() == books
    key = lambda r: str(r)
    assert sorted([(r["vec_id"], r["label"], r["code"], r["error"]) for r in got.codes.collect()], key=key) == sorted([(i, None if x is None else str(x), c, e) for i, x, c, e in want], key=key)
    sums = {}
    for _, label, _, e in want:
        sums[None if label is None else str(label)] = sums.get(None if label is None else str(label), 0) + e
    assert {r["label"]: r["label_error"] for r in vc.label_errors(got.codes).collect()} == sums
    decoded = vc.decode(got.codes, got.books).first()
    assert decoded["v"] == [x for p, c in enumerate(decoded["code"]) for x in books[p][c]]


def test_only_changes_are_shuffled(spark):
    rows = vc.materialize(spark.createDataFrame([(1, "a", [1, 2, 3, 4], [0, 1], [0, 0]), (2, "a", [5, 6, 7, 8], [1, 1], [1, 1])], vc.ROW), "t")
    got = {(r["part"], r["entry"], r["place"]): r["change"] for r in vc._changes(rows, 2, 2, 2).groupBy("part", "entry", "place").sum("change").withColumnRenamed("sum(change)", "change").collect()}
    assert got == {(1, 0, 0): -3, (1, 0, 1): -4, (1, 0, -1): -1, (1, 1, 0): 3, (1, 1, 1): 4, (1, 1, -1): 1}


def test_defined_results(spark):
    empty = vc.quantize(spark.createDataFrame([], SCHEMA))
    assert empty.codes.collect() == [] and empty.books.size == 0
    few = [(2, [1.0, 2.0, 3.0, 4.0], None, "", 0), (1, [1.0, 2.0, 3.0, 5.0], None, "", 0), (3, [1.0], 4, "", 0), (4, [], 4, "", 0)]
    got = {r["vec_id"]: r for r in vc.label_errors(vc.quantize(spark.createDataFrame(few, SCHEMA)).codes).collect()}
    assert got[1]["code"] == [0, 0, 0, 0] and got[2]["code"] == [0, 0, 0, 1] and got[1]["label_error"] == 0
    assert got[3]["code"] is None and got[4]["error"] is None and got[4]["label_error"] is None


def test_exact_beyond_doubles():
    x = np.array([[2**40 + 1, -(2**41)], [3, 2**30]], np.int64)
    books = np.array([[[2**40, -(2**41) + 2], [0, 0]]], np.int64)
    codes, errors = vc.nearest(x.reshape(2, 1, 2), books)
    assert codes.ravel().tolist() == [0, 1] and errors == [5, 9 + 2**60]
