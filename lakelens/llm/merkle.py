"""Operator 13, a Merkle manifest of a dataset, with proofs.

A forest of trees of one arity: leaves of a tree stand in an order, every run of consecutive nodes has the hash of its
digests as parent, up to one node. Nodes are combined as events: a task keeps partial parents, which accumulate indexed
child digests; sizes of trees say how many a parent has, and once all are there it is emitted with them and becomes a child
itself. Leaves are range-partitioned, so nearly all parents are completed where their leaves lie. What is left, children of
parents that span tasks, is shuffled by ever larger blocks of leaves until the trees are whole: two levels a round, in
each at most arity ** 2 nodes of a block, however large its tree is. Emitted parents link back to their children; proofs
follow these links from the top down, block by block, and each leaf is folded with its siblings again.

Digests are SHA-256; a parent hashes the hex digits of its children's. Places in a tree come from running counts over the
range partitions, so no tree is sorted or numbered by one task.

Defined results: a null tree key is a tree of its own and comes first; null order keys come first, equal ones are ordered by
their digests, equal rows are leaves of their own; fields that are null are hashed as `-`, unlike empty texts; a lone leaf is
its tree's root and, in a lone tree, the manifest's, with an empty proof; a null id is never tampered with; texts of any
length are hashed whole; an empty table gives no rows; columns that aren't fields are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 4
ARITY = 1 << BITS
#: Levels that one shuffle lifts the frontier by, and one step down of proofs.
STEP = 2
PENDING, PARENT, TOP = 0, 1, 2
NODE = "tree string, size bigint, level int, idx bigint, digest binary, kind int, children binary"
PLACED = "tree string, block bigint, turn int, level int, idx bigint, doc_id bigint, digest binary, other binary, shape binary"


PATH = "tree string, level int, idx bigint, siblings binary, top binary, shape binary"
FOLDED = "doc_id bigint, leaf binary, top binary, proof binary, folded binary"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch; the list is emptied."""
    names, types = zip(*[f.split() for f in schema.split(", ")], strict=True)
    made = pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))
    out.clear()
    return made


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256))


def hash_of(digests: bytes) -> bytes:
    """The hash of digests' hex digits."""
    return hashlib.sha256(digests.hex().encode()).digest()


@dataclass(frozen=True)
class Forest:
    """leaves: tree, size, idx and what they carry; nodes: parents with their children's digests, and each tree's top node."""

    leaves: DataFrame
    nodes: DataFrame
    largest: int

    def tops(self) -> DataFrame:
        return self.nodes.where(F.col("kind") == TOP).select("tree", "size", "digest")


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows of a written table with size (of their tree) and idx (their place in it), and the size of the largest tree."""
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order, "digest"]]
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    held = materialize(at, "merkle-leaves").withColumn("run", F.shiftright("at", 33))
    # A run is what a partition has of a tree: as many rows as partitions and trees.
    runs = held.groupBy("run", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = materialize(runs.select(F.col("run").alias("of_run"), F.col("tree").alias("of_tree"), "first", "n"), "merkle-runs")
    in_order = "PARTITION BY of_tree ORDER BY of_run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    offsets = runs.select("of_run", "of_tree", "first", F.expr(f"sum(n) OVER ({in_order}) - n").alias("offset"), F.expr("sum(n) OVER (PARTITION BY of_tree)").alias("size"))
    offsets = materialize(offsets, "merkle-offsets")
    largest = offsets.agg(F.max("size").alias("n")).first()["n"] or 0
    met = held.join(offsets, (F.col("run") == F.col("of_run")) & F.col("tree").eqNullSafe(F.col("of_tree")))
    return met.select(*rows.columns, "size", (F.col("at") - F.col("first") + F.col("offset")).alias("idx")), largest


def _block(height: int) -> Column:
    """The place of a node's first leaf, in blocks of ARITY ** height leaves."""
    return F.expr(f"shiftright(shiftleft(idx, {BITS} * level), {BITS * height})")


def _width(size: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def _combined(nodes: DataFrame) -> DataFrame:
    """One round: nodes are events for their parents; a parent that has all its children is emitted, and is an event itself."""

    def go(batches):
        partial: dict[tuple, dict[int, bytes]] = {}
        out: list[tuple] = []
        for b in batches:
            for tree, size, level, idx, held in zip(*[b.column(c).to_pylist() for c in ("tree", "size", "level", "idx", "digest")], strict=True):
                while True:
                    width = _width(size, level)
                    if width == 1:
                        out.append((tree, size, level, 0, held, TOP, None))
                        break
                    up, key = idx // ARITY, (tree, size, level, idx // ARITY)
                    children = partial.setdefault(key, {})
                    children[idx] = held
                    if len(children) < min(ARITY, width - up * ARITY):
                        break
                    del partial[key]
                    below = b"".join(children[i] for i in sorted(children))
                    level, idx, held = level + 1, up, hash_of(below)
                    out.append((tree, size, level, idx, held, PARENT, below))
                if len(out) >= 5000:
                    yield _batch(out, NODE)
        for (tree, size, level, _), children in partial.items():
            out += [(tree, size, level, i, d, PENDING, None) for i, d in children.items()]
            if len(out) >= 5000:
                yield _batch(out, NODE)
        if out:
            yield _batch(out, NODE)

    return nodes.select("tree", "size", "level", "idx", "digest").mapInArrow(go, NODE)


def forest(rows: DataFrame, order: list[str]) -> Forest:
    """The trees over leaves (tree, digest, order columns, others), a written table."""
    leaves, largest = placed(rows, order)
    steps = [materialize(_combined(leaves.withColumn("level", F.lit(0))), "merkle-nodes")]
    height = 0
    while ARITY**height < largest:
        height += STEP
        pending = steps[-1].where(F.col("kind") == PENDING)
        steps.append(materialize(_combined(pending.repartition(F.col("tree"), _block(height))), "merkle-nodes"))
    return Forest(leaves, reduce(DataFrame.unionByName, [s.where(F.col("kind") != PENDING) for s in steps]), largest)


def _turned(df: DataFrame, turn: int, block: Column, **columns: Column) -> DataFrame:
    """Rows for a step down: blocks take tops and paths first, then parents from above, then leaves."""
    empty = {"level": F.lit(0), "idx": F.lit(0), "doc_id": F.lit(None), "digest": F.lit(None), "other": F.lit(None), "shape": F.lit(None)}
    types = dict(f.split() for f in PLACED.split(", "))
    every = {"tree": F.col("tree"), "block": block, "turn": F.lit(turn)} | empty | columns
    return df.select(*[c.cast(types[n]).alias(n) for n, c in every.items()])


def fold(leaf: bytes, shape: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its siblings give. shape: a place and a number of siblings for each level."""
    at = 0
    for place, n in zip(shape[::2], shape[1::2], strict=True):
        run = siblings[at : at + 32 * n]
        leaf = hash_of(run[: 32 * place] + leaf + run[32 * place :])
        at += 32 * n
    return leaf


def _down(rows: DataFrame, low: int, last: bool) -> DataFrame:
    """Paths of the nodes of level `low`, or of leaves with what was folded: rows of blocks, in turn. A path holds the
    siblings of each level from a node up to the manifest's root."""

    def go(batches):
        at, paths, top, out = None, {}, None, []
        for b in batches:
            for tree, block, turn, level, idx, doc_id, held, other, shape in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (tree, block) != at:
                    at, paths = (tree, block), {}
                if turn == 0:  # a node whose path is known: its siblings, and the top of its tree
                    paths[level, idx], top = (shape, held), other
                elif turn == 1:
                    above, siblings = paths[level, idx]
                    n = len(held) // 32
                    for i in range(n):
                        path = bytes((i, n - 1)) + above, held[: 32 * i] + held[32 * i + 32 :] + siblings
                        if level - 1 > low or last:
                            paths[level - 1, idx * ARITY + i] = path
                        else:
                            out.append((tree, level - 1, idx * ARITY + i, path[1], top, path[0]))
                else:
                    above, siblings = paths[0, idx]
                    out.append((doc_id, held, top, hash_of(siblings), fold(other or held, above, siblings)))
                if len(out) >= 2000:
                    yield _batch(out, FOLDED if last else PATH)
        if out:
            yield _batch(out, FOLDED if last else PATH)

    return rows.mapInArrow(go, FOLDED if last else PATH)


def _paths(trees: Forest, above: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """The paths of a forest's leaves, from those of the trees' top nodes (tree, level, idx, siblings, top, shape). With
    carried (tree, idx, doc_id, digest, other of the leaves), what _down folds for them instead."""
    low = 0
    while ARITY ** (low + STEP) < trees.largest:
        low += STEP
    known = above.select("tree", "level", "idx", "siblings", "top", "shape")
    while low >= 0:
        last, block = low == 0 and carried is not None, _block(low + STEP)
        here = (F.col("level") > low) & (F.col("level") <= low + STEP)
        tops = known.where(here | ((F.col("level") == 0) & F.lit(low == 0)))
        rows = _turned(tops, 0, block, level=F.col("level"), idx=F.col("idx"), digest=F.col("siblings"), other=F.col("top"), shape=F.col("shape"))
        parents = trees.nodes.where((F.col("kind") == PARENT) & here)
        rows = rows.unionByName(_turned(parents, 1, block, level=F.col("level"), idx=F.col("idx"), digest=F.col("children")))
        if last:
            leaves = carried.withColumn("level", F.lit(0))
            rows = rows.unionByName(_turned(leaves, 2, block, idx=F.col("idx"), doc_id=F.col("doc_id"), digest=F.col("digest"), other=F.col("other")))
        in_turn = rows.repartition("tree", "block").sortWithinPartitions(F.col("tree"), F.col("block"), F.col("turn"), F.col("level").desc(), F.col("idx"))
        found = _down(in_turn, low, last)
        if last:
            return found
        known = known.unionByName(materialize(found, "merkle-paths"))
        low -= STEP
    return known.where("level = 0")


def _top_level(size: Column) -> Column:
    """The level of a tree's top node."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda n, i: n + F.when(F.pow(F.lit(float(ARITY)), i - 1) < size, 1).otherwise(0))


def manifest(leaves: DataFrame) -> tuple[DataFrame, bytes | None]:
    """doc_id, leaf, subroot, proof, folded (all digests) of leaves (tree, doc_id, digest, other), and the root of all trees,
    which stands over the trees' own roots in the order of their keys.

    folded is the root that `other`, or where that is null the leaf, gives together with the leaf's siblings: it is the
    manifest's root exactly if what was hashed is unchanged."""
    trees = forest(materialize(leaves.select("tree", "doc_id", "digest", "other"), "merkle-input"), ["doc_id"])
    over = forest(materialize(trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("size").alias("leaves"), "digest"), "merkle-subroots"), ["of"])
    top = over.tops().first()
    nothing = F.lit(b"")
    start = over.tops().select("tree", _top_level(F.col("size")).alias("level"), F.lit(0).cast("bigint").alias("idx"), nothing.alias("siblings"), F.lit(None).cast("binary").alias("top"), nothing.alias("shape"))
    paths = _paths(over, start).select(F.col("idx").alias("at"), "siblings", "shape")
    named = over.leaves.select("idx", F.col("of").alias("tree"), "leaves", F.col("digest").alias("top"))
    above = named.join(paths, F.col("at") == F.col("idx")).select("tree", _top_level(F.col("leaves")).alias("level"), F.lit(0).cast("bigint").alias("idx"), "siblings", "top", "shape")
    found = _paths(trees, materialize(above, "merkle-above"), trees.leaves)
    return found.select("doc_id", "leaf", F.col("top").alias("subroot"), "proof", "folded"), bytes(top["digest"]) if top else None
