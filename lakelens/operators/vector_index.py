"""A stored index of vectors in cells, searched a few cells at a time and wider where a filter leaves too little.

Cells are those of k-means over a bounded sample; every vector lies in the cell of its nearest centroid, and the table is
range-partitioned and sorted by cell, so that a search reads the row groups of its cells. A search probes the cells whose
centroids score highest, enough of them to hold several times what it wants, and ranks what a filter leaves there; a query
that fewer than k results survive tries again with twice the cells, and so twice the vectors. Once that would be half of the
cells, everything is read: what is missing then isn't there. Queries go in bounded blocks; a task sends on k rows of each at
most; vectors are never shuffled for a query.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import problems
from ..sources.readers import hash_sample
from ..storage import drop_path, file_system, materialize, new_path
from . import dense as scan
from .retrieval import dense, top_k

#: Bytes of all centroids as doubles, which every task holds.
CENTROID_BYTES = 64 << 20
#: More cells than this aren't listed in a filter.
LISTED = 2000


@dataclass(frozen=True)
class CellIndex:
    """vectors (cell, vec_id, embedding), centroids by cell, and what is known of them."""

    vectors: DataFrame
    centroids: np.ndarray
    meta: dict


@dataclass(frozen=True)
class Found:
    """ranking: query_id, vec_id, score, rank; stats: a row for each query, with what its last search did."""

    ranking: DataFrame
    stats: DataFrame


def k_means(rows: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of a sample; those that lose all their rows start again at the row farthest from its own."""
    at = np.random.default_rng(seed).choice(len(rows), cells, replace=False)
    centroids = rows[at].copy()
    for _ in range(rounds):
        own, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            away = (centroids * centroids).sum(1) - 2 * (part @ centroids.T)
            own[i : i + 4096] = away.argmin(1)
            far[i : i + 4096] = away.min(1) + (part * part).sum(1)
        count = np.bincount(own, minlength=cells)
        order = np.argsort(own, kind="stable")
        firsts = np.cumsum(count) - count
        used = np.flatnonzero(count)
        centroids[used] = np.add.reduceat(rows[order], firsts[used]) / count[used, None]
        empty = np.flatnonzero(count == 0)
        centroids[empty] = rows[np.argsort(-far)[: len(empty)]]
    return centroids


def content_digest(vectors: DataFrame) -> str:
    """A sum of hashes over all rows: it changes with any of them, and needs no order."""
    return str(vectors.agg(F.sum(F.xxhash64("vec_id", "embedding").cast("decimal(38,0)")).alias("h")).first()["h"] or 0)


def store(vectors: DataFrame, path: str, cells: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 17, model: str = "") -> CellIndex:
    """Writes the index of (vec_id, embedding): cells (their square root in number, unless told) from a sample of at most
    `sample` rows, then all vectors by cell, and meta last, so that a build that stops leaves none. Vectors that are null,
    not finite or of other lengths than most aren't indexed."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")
    dims = rows.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    dims = dims["d"] if dims else 0
    held = rows.where(F.size(problems(F.col("embedding"), dims, float("inf"))) == 0)
    n = held.count()
    most = max(1, CENTROID_BYTES // (8 * max(dims, 1)))
    few = hash_sample(held, sample, "vec_id", seed=seed).select("embedding").collect()
    number = max(1, min(round(n**0.5) if cells is None else cells, most, len(few))) if few else 0
    drawn = np.array([r["embedding"] for r in few], np.float64).reshape(len(few), dims)
    centroids = k_means(drawn, number, rounds, seed) if few else drawn
    placed = new_path(spark, "cells")
    by_cell = materialize(_placed(held, centroids), "", placed).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    by_cell.write.mode("overwrite").parquet(f"{path}/vectors")
    drop_path(spark, placed)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    meta = {"rows": n, "dims": dims, "cells": number, "sample": len(few), "model": model, "source": content_digest(rows)}
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return CellIndex(spark.read.parquet(f"{path}/vectors"), centroids, meta)


def _placed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    half = (centroids * centroids).sum(1) / 2

    def go(batches):
        for b in batches:
            cell = np.zeros(len(b), np.int32)
            for i in range(0, len(b), 2048):
                part = scan.rows_of(b.column("embedding").slice(i, 2048), centroids.shape[1])
                cell[i : i + 2048] = (part @ centroids.T - half).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("vec_id"), b.column("embedding")], names=["cell", "vec_id", "embedding"])

    return vectors.mapInArrow(go, f"cell int, vec_id bigint, embedding {dict(vectors.dtypes)['embedding']}")


def open_index(spark: SparkSession, path: str, source: DataFrame | None = None, model: str = "") -> CellIndex | None:
    """The index at a path; null if there is none, if it is of another model or, where source is given, of other vectors."""
    fs, done = file_system(spark, f"{path}/meta/_SUCCESS")
    if not fs.exists(done):
        return None
    meta = json.loads(spark.read.text(f"{path}/meta").head()["value"])
    if meta["model"] != model:
        return None
    if source is not None and meta["source"] != content_digest(source.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")):
        return None
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centroids = np.array([r["centroid"] for r in table], np.float64).reshape(len(table), meta["dims"])
    return CellIndex(spark.read.parquet(f"{path}/vectors"), centroids, meta)


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """For each row the numbers of the `probes` cells that score highest, in no order."""
    out = np.empty((len(rows), probes), np.int32)
    for i in range(0, len(rows), 1024):
        scores = rows[i : i + 1024] @ centroids.T
        out[i : i + 1024] = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
    return out


def ordered_cells(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """queries with cells: the numbers of the `probes` cells that score highest, best first."""

    def go(batches):
        for b in batches:
            at = np.full((len(b), probes), -1, np.int32)
            fits = [i for i, v in enumerate(b.column("query").to_pylist()) if v is not None and len(v) == centroids.shape[1]]
            for i in range(0, len(fits), 1024):
                rows = fits[i : i + 1024]
                scores = scan.rows_of(b.column("query").take(pa.array(rows)), centroids.shape[1]) @ centroids.T
                first = np.argpartition(-scores, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.tile(np.arange(len(centroids)), (len(rows), 1))
                at[rows] = np.take_along_axis(first, np.argsort(-np.take_along_axis(scores, first, 1), axis=1, kind="stable"), 1)
            lists = pa.ListArray.from_arrays(np.arange(0, at.size + 1, probes, dtype=np.int32), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("query"), lists], names=["query_id", "query", "cells"])

    return queries.select("query_id", "query").mapInArrow(go, f"query_id bigint, query {dict(queries.dtypes)['query']}, cells array<int>")


def _within(index: CellIndex, vectors: DataFrame, queries: DataFrame, probes: int, k: int, exclude_self: bool) -> DataFrame | None:
    """query_id, vec_id, score: each task's best rows of each query among the cells that it probes; queries are a block."""
    block = scan.block_of(queries.where(F.size("query") == index.centroids.shape[1]))
    if block is None:
        return None
    ids, matrix, centroids = block.ids, block.vectors, index.centroids
    asked = np.unique(nearest_cells(matrix, centroids, probes))
    held = vectors.where(F.col("cell").isin(asked.tolist())) if len(asked) <= min(LISTED, len(index.centroids) // 2) else vectors

    def go(batches):
        # Each task finds the cells again: they are many times what the queries are.
        cells = nearest_cells(matrix, centroids, probes).ravel()
        order = np.argsort(cells, kind="stable")
        sorted_cells, askers = cells[order], (order // probes).astype(np.int32)
        del cells, order
        best = scan.Best(len(ids), k)
        for b in batches:
            cell = b.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cell, prepend=-2, append=-2))
            for i, j in zip(edges, edges[1:], strict=False):
                lo, hi = np.searchsorted(sorted_cells, [cell[i], cell[i] + 1])
                at = askers[lo:hi]
                if not len(at):
                    continue
                for part in scan.pieces(b.slice(i, j - i), len(at)):
                    rows = part.column("vec_id").to_numpy()
                    scores = scan.millionths(scan.rows_of(part.column("embedding"), matrix.shape[1]) @ matrix[at].T)
                    if exclude_self:
                        scores[rows[:, None] == ids[at][None, :]] = scan.NONE
                    best.add(scores, rows, at)
        query, score, row = best.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(score / 1e6)], names=["query_id", "vec_id", "score"])

    return held.mapInArrow(go, "query_id bigint, vec_id bigint, score double")


def search(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 8, allowed: DataFrame | None = None, exclude_self: bool = False, times: int = 20, least: int = 200) -> Found:
    """The k best vectors of each query (query_id, query), of those in `allowed` (vec_id) if given.

    A first search probes `probes` cells, or as many as hold max(times * k, least) vectors on average; that doubles for the
    queries with fewer than k results. Ids of queries are distinct. A query without a vector of the index's length finds
    nothing. What a filter allows is stored once for all rounds."""
    spark, cells, n = queries.sparkSession, len(index.centroids), index.meta["rows"]
    nothing = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    active = materialize(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "query"), "queries")
    held = index.vectors if allowed is None else materialize(index.vectors.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi").select("cell", "vec_id", "embedding"), "allowed")
    wanted = k if allowed is None else max(times * k, least)
    probes, widenings, rankings, stats = max(1, probes, -(-wanted * cells // max(n, 1))), 0, [], []
    while True:
        last = 2 * probes >= cells
        if last:
            found, used = dense(held.select("vec_id", "embedding"), active, k, None, exclude_self), {"fetch_k": n, "probes": cells}
        else:
            rows = scan.by_blocks(active, lambda q, p=probes: _within(index, held, q, p, k, exclude_self), nothing, 4 * probes)
            found, used = top_k(rows, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k), {"fetch_k": -(-probes * n // cells), "probes": probes}
        found = materialize(found.select("query_id", "vec_id", "score", "rank"), "ranking")
        counts = active.select("query_id").join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("survivors")), "query_id", "left").fillna(0, ["survivors"])
        counts = materialize(counts.select("query_id", "survivors", *[F.lit(v).cast("bigint").alias(c) for c, v in used.items()], F.lit(widenings).alias("widenings")), "ranked")
        done = counts if last else counts.where(F.col("survivors") >= k)
        rankings.append(found if last else found.join(done.select("query_id"), "query_id", "left_semi"))
        stats.append(done)
        short = None if last else counts.where(F.col("survivors") < k)
        if short is None or short.isEmpty():
            break
        active = materialize(active.join(short.select("query_id"), "query_id", "left_semi"), "queries")
        probes, widenings = 2 * probes, widenings + 1
    every, told = rankings[0], stats[0]
    for r, s in zip(rankings[1:], stats[1:], strict=True):
        every, told = every.unionByName(r), told.unionByName(s)
    told = told.select("query_id", F.lit(k).alias("k"), "fetch_k", "probes", "survivors", "widenings", (F.col("survivors") < k).alias("short"), F.lit(index.meta["rows"]).cast("bigint").alias("index_size"))
    return Found(every.select("query_id", "vec_id", "score", "rank"), told)


def probes_for(index: CellIndex, recall: float = 0.92, k: int = 10, sample: int = 256, seed: int = 29) -> int:
    """The least number of cells by which a sample of the index's vectors, as queries, find that share of their k nearest
    others; a sample is searched exactly for it."""
    if index.meta["rows"] <= 1:
        return 1
    held = hash_sample(index.vectors, sample, "vec_id", seed=seed).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    asked = materialize(held, "probing")
    near = dense(index.vectors.select("vec_id", "embedding"), asked, k, exclude_self=True).select("query_id", "vec_id").toArrow().to_pandas()
    wanted = near.vec_id.drop_duplicates().tolist()  # at most k times the sample
    cell_of = {r["vec_id"]: r["cell"] for r in index.vectors.where(F.col("vec_id").isin(wanted)).select("vec_id", "cell").collect()}
    place = {}
    for r in ordered_cells(asked, index.centroids, len(index.centroids)).collect():
        place[r["query_id"]] = {c: i for i, c in enumerate(r["cells"])}
    needed = sorted(place[q][cell_of[v]] + 1 for q, v in zip(near.query_id, near.vec_id, strict=True))
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
