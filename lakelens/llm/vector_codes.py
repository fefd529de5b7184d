"""Operator 11, vector code compression: a product quantizer whose Lloyd rounds are maintained by differences.

Components become integers, floor(scale * x), so that every step is exact. A vector is cut into equal consecutive parts,
and each part position has a codebook, which starts as that part of the vectors of least ids. A round assigns each part
to the nearest entry of its codebook (squared Euclidean distance, ties to the lower index) and writes the vectors with
their new and their previous assignment. Only parts whose assignment changed then contribute: plus their components to the
new entry, minus to the old one, summed up within each task before the shuffle. The running sums and counts are a table
of their own that each round adds to, and an entry becomes the floor of sum / count; one that nothing uses stays. Codebooks
and running sums are bounded by entries * dimensions, whatever the number of vectors; they alone pass through the driver.

Distances are integers in doubles, 64-bit integers or Python's, whichever holds them exactly; what doesn't fit a long at the
end raises an error, as Spark's own arithmetic does.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped; vectors of another
length than that of the least id are kept with a null code and error, and do not shape the codebooks; a length that the
parts don't divide is an error; equal vectors get equal codes; ids that repeat are rows of their own, ordered by their
vectors where codebooks start; null ids come after all others there; with fewer vectors than entries each is an entry; null
labels are one label; an empty table gives no rows and empty codebooks; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, new_path

ROW = "vec_id bigint, label string, v array<bigint>, code array<int>, before array<int>"


@dataclass(frozen=True)
class Quantized:
    """codes: vec_id, label, code (an index for each part), error; books: entries by part, entry and place within the part."""

    codes: DataFrame
    books: np.ndarray


def integers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _largest(*arrays: np.ndarray) -> int:
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, in the fastest numbers that hold them."""
    most = 4 * max(x.shape[1], 1) * _largest(x, entries) ** 2
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    x, c = x.astype(kind), entries.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For rows of parts: the index of each part's nearest entry, and the row's squared distances summed over parts."""
    codes, errors = np.zeros(x.shape[:2], np.int32), [0] * len(x)
    for p in range(x.shape[1]):
        far = distances(x[:, p], books[p])
        codes[:, p] = far.argmin(1) if len(far) else 0
        errors = [a + int(b) for a, b in zip(errors, far[np.arange(len(x)), codes[:, p]].tolist(), strict=True)]
    return codes, errors


def _lists(codes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel(), pa.int32()))


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with a new code; the one they had stands beside it."""
    parts, _, width = books.shape

    def go(batches):
        for b in batches:
            codes, _ = nearest(_matrix(b.column("v"), parts, width), books)
            held = [b.column(c) for c in ("vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*held, _lists(codes), b.column("code")], names=["vec_id", "label", "v", "code", "before"])

    return rows.mapInArrow(go, ROW)


def _changes(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """part, entry, place, change: what a task's changed parts add to the running sums and take from them; place -1 counts."""

    def go(batches):
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column("v"), parts, width)
            fits = len(x) * _largest(x) < 1 << 62
            now = b.column("code").flatten().to_numpy().reshape(-1, parts)
            before = np.array([r if r is not None else [-1] * parts for r in b.column("before").to_pylist()], np.int64).reshape(-1, parts)
            for p in range(parts):
                moved = now[:, p] != before[:, p]
                for at, sign in ((now[moved, p], 1), (before[moved, p], -1)):
                    known = at >= 0
                    part = np.zeros((entries, width), np.int64 if fits else object)
                    np.add.at(part, at[known], x[moved, p][known] if fits else x[moved, p][known].astype(object))
                    sums[p] += sign * part.astype(object)
                    counts[p] += sign * np.bincount(at[known], minlength=entries)
        p, e, w = np.nonzero(sums != 0)
        cp, ce = np.nonzero(counts)
        change = [int(v) for v in sums[p, e, w]] + counts[cp, ce].tolist()
        columns = [[*p.tolist(), *cp.tolist()], [*e.tolist(), *ce.tolist()], [*w.tolist(), *[-1] * len(cp)]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array(change, pa.int64())], names=["part", "entry", "place", "change"])

    changed = rows.where(~F.col("code").eqNullSafe(F.col("before"))).select("v", "code", "before")
    return changed.mapInArrow(go, "part int, entry int, place int, change bigint")


def _updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries as floors of sum / count; those without a part stay."""
    out, total, count = books.copy(), np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    for r in sums.toLocalIterator():
        if r["place"] < 0:
            count[r["part"], r["entry"]] = r["total"]
        else:
            total[r["part"], r["entry"], r["place"]] = r["total"]
    used = count > 0
    out[used] = np.array([[t // n for t in row] for row, n in zip(total[used].tolist(), count[used].tolist(), strict=True)], np.int64).reshape(-1, books.shape[2])
    return out


def quantize(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Quantized:
    """Codes of vectors (vec_id, embedding, label) under codebooks fitted in a fixed number of rounds."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), integers(F.col("embedding"), scale).alias("v"))
    path = new_path(spark, "vectors")
    rows = materialize(kept.select("*", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("array<int>").alias("before")), "", path)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    least = rows.orderBy(*order).select(F.size("v").alias("n")).first()
    dims = least["n"] if least else 0
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    of_length = F.size("v") == dims
    first = rows.where(of_length).orderBy(*order).select("v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    if not first:
        return Quantized(rows.select("vec_id", "label", "code", F.lit(None).cast("bigint").alias("error")), books)
    other = rows.where(~of_length).select("vec_id", "label", "code", F.lit(None).cast("bigint").alias("error"))
    other, now, now_path = materialize(other, "other-lengths"), rows.where(of_length), path
    sums, sums_path = None, None
    for _ in range(rounds):
        following = new_path(spark, "vectors")
        now = materialize(_assigned(now, books), "", following)
        drop_path(spark, now_path)
        now_path = following
        changes = _changes(now, parts, books.shape[1], books.shape[2])
        every = changes if sums is None else changes.unionByName(sums.withColumnRenamed("total", "change"))
        following = new_path(spark, "running-sums")
        sums = materialize(every.groupBy("part", "entry", "place").agg(F.sum("change").alias("total")), "", following)
        if sums_path:
            drop_path(spark, sums_path)
        sums_path = following
        books = _updated(books, sums)
    return Quantized(encode(now, books).unionByName(other), books)


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of integer vectors (vec_id, label, v), all of the codebooks' length."""
    parts, _, width = books.shape

    def go(batches):
        for b in batches:
            codes, errors = nearest(_matrix(b.column("v"), parts, width), books)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(codes), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(go, "vec_id bigint, label string, code array<int>, error bigint")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with v, the integer vector that a code stands for."""
    table = F.broadcast(codes.sparkSession.createDataFrame([(books.tolist(),)], "books array<array<array<bigint>>>"))
    parts = F.transform("code", lambda c, p: F.get(F.get(F.col("books"), p), c))
    return codes.crossJoin(table).select(*codes.columns, F.flatten(parts).alias("v"))


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of errors over the rows of its label. Sums are combined before their shuffle, and a
    frequent label's rows meet its sum by broadcast or in a join that adaptive execution can split."""
    held = materialize(codes, "codes")
    sums = materialize(held.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    return held.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def code_text(code: Column) -> Column:
    """Indexes in the order of parts, two hex digits each."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def books_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and place, as decimals between commas."""
    return ",".join(map(str, books.ravel().tolist()))
