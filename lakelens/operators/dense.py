"""Exact search of query vectors among all vectors: products of matrices over Arrow batches, so that no pair is a row.

Queries go in blocks of bounded bytes, which every task holds; vectors stay where they lie. A task keeps, for each query,
its best rows so far, and skips at once what can't be among them. Scores are whole millionths, so that ties are ties on
every engine. Vectors that are null, hold nulls or NaN, or have another length than the queries are nobody's neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Bytes of the queries that go to every task at once, as doubles.
BLOCK_BYTES = 8 << 20
#: Scores that a task holds at once.
CELLS = 1 << 18
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Block:
    """Some queries: their ids, vectors, and other columns by name."""

    ids: np.ndarray
    vectors: np.ndarray
    more: dict[str, list]


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The matrix of a list column, all of that length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def sound(batch: pa.RecordBatch, name: str, dims: int) -> pa.RecordBatch:
    """The rows whose vector is there and has the length."""
    return batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(name)), dims), False))


def block_of(queries: DataFrame, *more: str) -> Block | None:
    """The queries (query_id, query), which must be few, as a block; null if there is none."""
    table = queries.select("query_id", "query", *more).toArrow().combine_chunks()
    lengths = pc.list_value_length(table.column("query"))
    dims = pc.max(lengths).as_py()
    if not dims:
        return None
    table = table.filter(pc.fill_null(pc.equal(lengths, dims), False)).combine_chunks()
    batches = table.to_batches()
    vectors = np.concatenate([rows_of(b.column("query"), dims) for b in batches])
    return Block(table.column("query_id").to_numpy(), vectors, {c: table.column(c).to_pylist() for c in more})


def by_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame | None], none: DataFrame, beside: int = 0) -> DataFrame:
    """search(queries), which must treat each query_id by itself. Queries of more than BLOCK_BYTES go by a hash of their id
    into blocks below that, whose results are stored one after the other. beside: further bytes of each query."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query")).alias("dims")).first()
    most = max(1, BLOCK_BYTES // (8 * max(size["dims"] or 1, 1) + beside))
    if size["n"] <= most:
        found = search(queries)
        return none if found is None else found
    count, out = -(-11 * size["n"] // (10 * most)), none  # a tenth of room, since hashes don't deal evenly
    for i in range(count):
        found = search(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i))
        out = out if found is None else out.unionByName(materialize(found, "query-block"))
    return out


def millionths(products: np.ndarray, decimals: int = 6) -> np.ndarray:
    """Scores as whole numbers of the last decimal, halves up in size; NaN as the least of all."""
    sound = np.isfinite(products)
    micro = np.rint(np.where(sound, products, 0) * 1e6).astype(np.int64)
    if decimals < 6:
        unit = 10 ** (6 - decimals)
        micro = np.sign(micro) * ((np.abs(micro) + unit // 2) // unit)
    return np.where(sound, micro, NONE)


class Best:
    """The best k rows of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, NONE, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        """scores: rows by queries, of which `queries` are the numbers."""
        row, at = np.nonzero((scores >= self.least[queries]) & (scores != NONE))
        self.held.append((queries[at], scores[row, at], ids[row]))
        self.size += len(row)
        if self.size > max(CELLS, 2 * self.k * len(self.least)):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        query, score, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        full = place == self.k - 1
        self.least[query[full]] = score[full]
        self.held, self.size = [(query[kept], score[kept], row[kept])], int(kept.sum())
        return self.held[0]


def pieces(batch: pa.RecordBatch, queries: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(queries, 1))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def top(vectors: DataFrame, block: Block, k: int, exclude_self: bool = False, decimals: int = 6) -> DataFrame:
    """query_id, vec_id, score: each task's k best rows of each query; the best of all are among them."""
    ids, matrix = block.ids, block.vectors
    every = np.arange(len(ids))

    def go(batches):
        best = Best(len(ids), k)
        for b in batches:
            for part in pieces(sound(b, "embedding", matrix.shape[1]), len(ids)):
                rows = part.column("vec_id").to_numpy()
                scores = millionths(rows_of(part.column("embedding"), matrix.shape[1]) @ matrix.T, decimals)
                if exclude_self:
                    scores[rows[:, None] == ids[None, :]] = NONE
                best.add(scores, rows, every)
        query, score, row = best.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(score / 10.0**decimals)], names=["query_id", "vec_id", "score"])

    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")
    return held.mapInArrow(go, "query_id bigint, vec_id bigint, score double")


def _coded(labels: list, known: dict) -> np.ndarray:
    return np.array([-2 if x is None else known.get(x, -1) for x in labels], np.int64)


def best_of_label(vectors: DataFrame, block: Block, exclude_self: bool) -> DataFrame:
    """query_id, micro, vec_id: each task's best row of the query's own label."""
    ids, matrix = block.ids, block.vectors
    known = {x: i for i, x in enumerate(sorted({x for x in block.more["query_label"] if x is not None}))}
    own = np.array([-3 if x is None else known[x] for x in block.more["query_label"]], np.int64)
    every = np.arange(len(ids))

    def go(batches):
        best = Best(len(ids), 1)
        for b in batches:
            for part in pieces(sound(b, "embedding", matrix.shape[1]), len(ids)):
                rows = part.column("vec_id").to_numpy()
                scores = millionths(rows_of(part.column("embedding"), matrix.shape[1]) @ matrix.T)
                other = _coded(part.column("label").to_pylist(), known)[:, None] != own[None, :]
                scores[other | (rows[:, None] == ids[None, :] if exclude_self else False)] = NONE
                best.add(scores, rows, every)
        query, score, row = best.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(score), pa.array(row)], names=["query_id", "micro", "vec_id"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(go, "query_id bigint, micro bigint, vec_id bigint")


def counted_before(vectors: DataFrame, block: Block, exclude_self: bool) -> DataFrame:
    """query_id, n: how many of a task's rows come before the query's own row (micro, at) in the order of the search."""
    ids, matrix = block.ids, block.vectors
    micro, at = (np.array(block.more[c], np.int64) for c in ("micro", "at"))

    def go(batches):
        n = np.zeros(len(ids), np.int64)
        for b in batches:
            for part in pieces(sound(b, "embedding", matrix.shape[1]), len(ids)):
                rows = part.column("vec_id").to_numpy()[:, None]
                scores = millionths(rows_of(part.column("embedding"), matrix.shape[1]) @ matrix.T)
                before = (scores > micro) | ((scores == micro) & (rows < at))
                n += (before & (rows != ids[None, :]) if exclude_self else before).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["query_id", "n"])

    return vectors.select("vec_id", "embedding").mapInArrow(go, "query_id bigint, n bigint")
