"""Operator 5, exact n-gram Jaccard join by token-group matrices.

1. Every text becomes its set of distinct word shingles; equal sets are one class.
2. Co-location, by two conditions that every link meets. (a) Two sets of similarity t differ in at most H shingles, where H
   follows from their sizes. Hash space is cut into H + 1 parts, so linked sets agree on at least one whole part (the
   pigeonhole bound of PartEnum, Arasu et al., 2006). (b) With shingles ordered from rare to frequent, linked sets share
   one of the first n - ceil(t n) + 1 of both (the prefix bound, Chaudhuri et al., 2006). Any one order serves for that;
   counts of all shingles by a hash, in a table that grows with the corpus up to LOAD_BITS, make passages that many
   documents hold come last, which so tie nothing together. Classes that share a digest, or a shingle, are joined; sets
   that lie in one component of both graphs are a family: all links of a class lie within its family.
   Families are refined by parity sketches: bit i of a sketch tells whether an odd number of shingles fall on it, and two
   sketches differ in no more bits than the sets in shingles. Only pairs within the bound stay connected.
3. Token-group matrix. A family's classes are dealt into blocks of bounded size, and each pair of blocks is a task. There,
   similar sets (by least hash and size) form groups of at most 16, each a row with the union of its members'
   shingles. A group's overlap with a query bounds that of any member, and only groups whose bound reaches the
   threshold are opened, for exact counts. Sets that are connected already are not compared again.
4. Components of the links that were found give the smallest doc_id reachable.

No link is lost: every step before the exact count only drops pairs that can't reach the threshold.

Defined results: null and empty texts have empty sets, linked with nothing; texts of fewer words than a shingle are one
shingle; repeated rows and equal texts share a class; null doc_ids never name a component unless it has no other id; rows
that share an id, null too, are judged by their own texts; texts of any length are shingled whole, in runs of a megabyte;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, new_path, shuffle_partitions, trimmed
from .graph import connected_components
from .shingles import mix, shingle_sets

#: Classes and shingles of a block, at most on average.
BLOCK_SETS, BLOCK_SHINGLES = 128, 200_000
#: Sketches of a block, on average, but for families that this would part into more blocks than the second number;
#: and the bytes of a block's sketches, at most on average.
SKETCH_SETS, SKETCH_BLOCKS, SKETCH_BYTES = 192, 24, 1 << 20
GROUP = 16
#: Counters of shingles are 2 ** bits, of a byte each, about one for eight shingles and these at most.
LOAD_BITS, LOAD_RANGES = 26, 64


@cache
def _levels(num: int, den: int) -> np.ndarray:
    """Least size of each level: sets that can link are of the same level or of neighbouring ones."""
    out = [1, 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out, np.int64)


def _parts(level: int, num: int, den: int) -> int:
    largest = int(_levels(num, den)[level + 1]) - 1
    return 2 * largest * (den - num) // (den + num) + 1


def set_key(s: np.ndarray) -> bytes:
    """128-bit identity of a set of shingles."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(s))], ">u8").tobytes()


def part_digests(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Digests of the parts of a sorted set, for its own level and the next."""
    levels = _levels(num, den)
    own = int(np.searchsorted(levels, len(s), "right")) - 1
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s), out=sums[1:])
    out = []
    for level in (own, own + 1):
        n = _parts(level, num, den)
        part = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
        out.append(mix((sums[edges[1:]] - sums[edges[:-1]]) ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(level << 32))))
    return np.concatenate(out)


def _bytes_of(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set over as many bits as it has shingles, up to the next power of two, 256 at least."""
    bits = max(256, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_linked(sizes: np.ndarray, sketches: list[bytes], sides: np.ndarray, across: bool, num: int, den: int) -> list[int]:
    """For each set the least index that it is connected with by pairs whose sizes and sketches allow a link."""
    n = len(sizes)
    order = np.argsort(sizes, kind="stable")
    union, root = _Union(n), np.arange(n)
    words: dict[int, np.ndarray] = {}  # by bits: sketches of all sets that have as many or more, folded
    width = np.array([len(x) for x in sketches])

    def folded(w: int) -> np.ndarray:
        if w not in words:
            out = np.zeros((n, w // 8), np.uint64)
            for i in np.flatnonzero((width == w) | (width == 2 * w)):
                x = np.frombuffer(sketches[i], np.uint64)
                out[i] = x if len(x) == w // 8 else x[: w // 8] ^ x[w // 8 :]
            words[w] = out
        return words[w]

    ordered = sizes[order]
    for p, i in enumerate(order.tolist()):
        a = int(sizes[i])
        end = int(np.searchsorted(ordered, a * den // num, "right"))  # partners are larger, within the threshold
        some = order[p + 1 : end]
        some = some[root[some] != root[i]]
        if across:
            some = some[sides[some] != sides[i]]
        if not len(some):
            continue
        table = folded(int(width[i]))
        differ = np.bitwise_count(table[some] ^ table[i]).sum(axis=1)
        near = some[differ * (den + num) <= (a + sizes[some]) * (den - num)]
        for j in near.tolist():
            union.join(i, j)
        if len(near):
            mine = union.find(i)
            for r in {int(root[j]) for j in [*near.tolist(), i]}:
                root[root == r] = mine
    return [union.find(i) for i in range(n)]


def refined(classes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b (by k): edges that connect what sketches can't tell apart, from classes (k, n, sketch, family)."""
    n_parts = shuffle_partitions(classes.sparkSession)
    sizes = classes.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("sketch")).alias("bytes")).where("m > 1")
    blocks = F.greatest(F.least(F.ceil(F.col("m") / SKETCH_SETS), F.lit(SKETCH_BLOCKS)), F.ceil(F.col("bytes") / SKETCH_BYTES)).cast("int")
    dealt = classes.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "k", "n", "sketch"
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: list[tuple], across: bool) -> pa.RecordBatch | None:
        ks = [r[1] for r in rows]
        least = sketch_linked(np.array([r[2] for r in rows], np.int64), [r[3] for r in rows], np.array([r[0] for r in rows]), across, num, den)
        edges = [(ks[i], ks[j]) for i, j in enumerate(least) if i != j]
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=schema) if edges else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for family, lo, hi, *row in zip(*[b.column(c).to_pylist() for c in ("family", "low", "high", "block", "k", "n", "sketch")], strict=True):
                if (family, lo, hi) != key:
                    if len(rows) > 1 and (out := solve(rows, key[1] != key[2])) is not None:
                        yield out
                    key, rows = (family, lo, hi), []
                rows.append(tuple(row))
        if len(rows) > 1 and (out := solve(rows, key[1] != key[2])) is not None:
            yield out

    return pairs.repartition(n_parts, "family", "low", "high").sortWithinPartitions("family", "low", "high").mapInArrow(trimmed(run), "a bigint, b bigint")


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (a hash that tells texts of one id apart), n_shingles, cls (null for an empty set), k, its first half, and
    the set's sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("k", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                sets = [(len(s), set_key(s), sketch(s)) if len(s) else (0, None, None) for s in shingle_sets(_bytes_of(some.column(1)), size)]
                cols = [[x[0] for x in sets], [x[1] for x in sets], [_half(x[1]) for x in sets], [x[2] for x in sets]]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True)]], schema=schema)

    return _texts(docs).withColumn("t", _text_key()).mapInArrow(trimmed(run), "doc_id bigint, t bigint, n_shingles bigint, cls binary, k bigint, sketch binary")


def _text_key() -> Column:
    return F.xxhash64("text", F.length("text"))


def _half(key: bytes | None) -> int | None:
    return None if key is None else int.from_bytes(key[:8], "big", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


@dataclass(frozen=True)
class Loads:
    """How often shingles occur in all sets together, by the last bits of their hash: eight steps for each doubling."""

    bits: int
    steps: np.ndarray

    def prefix(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        """The first shingles of a set from rare to frequent, of which one is in every set that it can link with."""
        k = len(s) + 1 + (-num * len(s) // den)
        if k >= len(s):
            return s
        place = (self.steps[s & np.uint64((1 << self.bits) - 1)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
        return s[np.argpartition(place, k - 1)[:k]]


def shingle_loads(docs: DataFrame, size: int, total: int) -> Loads:
    """Counts over all documents' sets, which have `total` shingles: tasks send sparse counts, dealt by ranges of the
    counters; the driver gets a byte for each counter."""
    bits = int(np.clip(int(max(total, 1) // 8).bit_length(), 16, LOAD_BITS))
    width = (1 << bits) // LOAD_RANGES
    blob = pa.schema([("range", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

    def sparse(held: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(u, np.arange(LOAD_RANGES + 1) * width)
        zstd = zstandard.ZstdCompressor(level=1)
        some = [i for i in range(LOAD_RANGES) if edges[i + 1] > edges[i]]
        steps = lambda x: np.diff(x, prepend=np.uint32(0))  # the first place of a range stands as it is, the others as steps
        packed = lambda x: zstd.compress(x.astype("<u4").tobytes())
        cols = [some, [packed(steps(u[edges[i] : edges[i + 1]])) for i in some], [packed(n[edges[i] : edges[i + 1]]) for i in some]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, blob, strict=True)], schema=blob)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for some in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                for s in shingle_sets(_bytes_of(some.column(0)), size):
                    held.append((s & np.uint64((1 << bits) - 1)).astype(np.uint32))
                    n += len(s)
                if n > 4_000_000:
                    yield sparse(held)
                    held, n = [], 0
        if n:
            yield sparse(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, sums = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for r, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                places = np.cumsum(np.frombuffer(zstd.decompress(at), "<u4"), dtype=np.int64) - r * width
                sums.setdefault(r, np.zeros(width, np.int64))[places] += np.frombuffer(zstd.decompress(n), "<u4")
        for r, x in sums.items():
            steps = np.minimum(np.round(8 * np.log2(1 + x)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([steps.tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=blob)

    counted = _texts(docs).select("text").mapInArrow(trimmed(count), "range int, at binary, n binary").repartitionById(LOAD_RANGES, F.col("range"))
    steps = np.zeros(1 << bits, np.uint8)
    for r in counted.mapInArrow(trimmed(add), "range int, at binary, n binary").select("range", "at").collect():  # 2 ** bits bytes
        steps[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["at"], np.uint8)
    return Loads(bits, steps)


def candidate_ties(docs: DataFrame, size: int, num: int, den: int, shared: Broadcast[Loads]) -> DataFrame:
    """kind, a, b: classes (by k) that share the digest of a part (kind 0) or a shingle of their prefixes (kind 1), each with
    the least of them. Digests travel as arrays, dealt by their value, a row for each bucket and kind of a batch."""
    n = shuffle_partitions(docs.sparkSession)
    blob = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("digests", pa.binary()), ("owners", pa.binary()), ("names", pa.binary())])
    tie = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for s in shingle_sets(_bytes_of(some.column(1)), size):
                    if len(s) and (k := _half(set_key(s))) not in found:
                        found[k] = part_digests(s, num, den), mix(shared.value.prefix(s, num, den))
                if not found:
                    continue
                names = np.array(list(found), np.int64)
                for kind in (0, 1):
                    own = [x[kind] for x in found.values()]
                    digests = np.concatenate(own)
                    owners = np.repeat(np.arange(len(own), dtype=np.uint16), [len(x) for x in own])
                    bucket = (digests % np.uint64(n)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    at = np.searchsorted(bucket[order], np.arange(n + 1))
                    parts = [(i, order[x:y]) for i, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
                    named = [np.unique(owners[o], return_inverse=True) for _, o in parts]
                    cols = [[i for i, _ in parts], [kind] * len(parts), [digests[o].tobytes() for _, o in parts], [x.astype(np.uint16).tobytes() for _, x in named], [names[u].tobytes() for u, _ in named]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, blob, strict=True)], schema=blob)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for b in batches:
            for kind, d, o, names in zip(*[b.column(c).to_pylist() for c in ("kind", "digests", "owners", "names")], strict=True):
                ds, ks = held.setdefault(kind, ([], []))
                ds.append(np.frombuffer(d, np.uint64))
                ks.append(np.frombuffer(names, np.int64)[np.frombuffer(o, np.uint16)])
        for kind in sorted(held):
            ds, ks = held.pop(kind)
            d, k = np.concatenate(ds), np.concatenate(ks)
            del ds, ks
            order = np.argsort(d, kind="stable")
            d, k = d[order], k[order]
            edges = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            least = np.repeat(np.minimum.reduceat(k, edges), np.diff(np.append(edges, len(d))))
            apart = k != least
            ties = np.unique(np.stack([k[apart], least[apart]], 1), axis=0)
            for i in range(0, len(ties), 100_000):
                some = ties[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some[:, 0]), pa.array(some[:, 1])], schema=tie)

    cuts = _texts(docs).mapInArrow(trimmed(cut), "bucket int, kind int, digests binary, owners binary, names binary")
    return cuts.repartitionById(n, F.col("bucket")).mapInArrow(trimmed(meet), "kind int, a bigint, b bigint")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], sides: list[int], across: bool, num: int, den: int) -> list[int]:
    """For each set the least index that it is connected with, by a token-group matrix. across: only pairs of two sides."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)  # other shingles can't be in two sets
    rank = np.full(len(counts), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    edges = np.cumsum(sizes)
    tokens = [x[x >= 0] for x in (rank[local[e - k : e]] for e, k in zip(edges, sizes, strict=True))]
    least = [int(mix(s ^ np.uint64(0x123456789)).min()) for s in sets]
    order = sorted(range(n), key=lambda i: (least[i], sizes[i]))
    groups = [np.array(order[i : i + GROUP]) for i in range(0, n, GROUP)]
    matrix = np.zeros((len(groups), len(shared)), bool)
    rows = []
    for g, members in enumerate(groups):
        own = np.zeros((len(members), len(shared)), bool)
        for r, i in enumerate(members):
            own[r, tokens[i]] = True
        rows.append(own)
        matrix[g] = own.any(axis=0)
    low, high = np.array([sizes[m].min() for m in groups]), np.array([sizes[m].max() for m in groups])
    place = np.empty(n, np.int64)
    for p, i in enumerate(order):
        place[i] = p
    side = np.array(sides)
    union = _Union(n)
    for i in order:
        t, size = tokens[i], sizes[i]
        if den * len(t) < num * size:  # too few shingles in common with all others together
            continue
        bound = matrix[:, t].sum(axis=1)
        open_ = np.flatnonzero((den * bound >= num * np.maximum(size, low)) & (den * high >= num * size) & (num * low <= den * size))
        for g in open_.tolist():
            members = groups[g]
            keep = (place[members] > place[i]) & (den * np.minimum(sizes[members], size) >= num * np.maximum(sizes[members], size))
            if across:
                keep &= side[members] != side[i]
            mine = union.find(i)
            at = [r for r in np.flatnonzero(keep).tolist() if union.find(int(members[r])) != mine]
            if not at:
                continue
            common = rows[g][np.ix_(at, t)].sum(axis=1)
            for r, c in zip(at, common.tolist(), strict=True):
                j = int(members[r])
                if den * c >= num * (int(size) + int(sizes[j]) - c):
                    union.join(i, j)
    return [union.find(i) for i in range(n)]


def _links(blocks: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """a, b: edges that connect the classes of each pair of blocks. Rows come sorted by family and pair of blocks."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def solve(rows: list[tuple[bytes, bytes, int]], across: bool) -> pa.RecordBatch | None:
        found: dict[bytes, tuple[np.ndarray, int]] = {}
        for (cls, _, side), s in zip(rows, shingle_sets([r[1] for r in rows], size), strict=True):
            if cls not in found and len(s) and set_key(s) == cls:
                found[cls] = (s, side)
        if len(found) < 2:
            return None
        keys = list(found)
        least = linked([found[k][0] for k in keys], [found[k][1] for k in keys], across, num, den)
        edges = [(keys[i], keys[j]) for i, j in enumerate(least) if i != j]
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], schema=schema) if edges else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("family", "low", "high", "block", "cls")]
            for family, lo, hi, block, cls, text in zip(*cols, _bytes_of(b.column("text")), strict=True):
                if (family, lo, hi) != key:
                    if rows and (out := solve(rows, key[1] != key[2])) is not None:
                        yield out
                    key, rows = (family, lo, hi), []
                rows.append((cls, text, block))
        if rows and (out := solve(rows, key[1] != key[2])) is not None:
            yield out

    return blocks.mapInArrow(trimmed(run), "a binary, b binary")


def _components(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows of shingled(), and cls, component (a class too) of every class."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    members = materialize(shingled(docs, size), "shingled")
    known = members.where("cls is not null")
    # One text stands for its class: that of the least id, nulls last; the text's hash tells rows of one id apart.
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("t").alias("t")))
    classes = known.groupBy("cls", "k").agg(least.alias("least"), F.first("n_shingles").alias("n")).select("cls", "k", F.col("least.id").alias("least_id"), F.col("least.t").alias("least_t"), "n")
    repeated = not known.groupBy("doc_id", "t").count().where("count > 1").isEmpty()
    sketched = members.where("cls is not null").select("k", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["k"])
    total = classes.agg(F.sum("n")).first()[0] or 0
    tied = new_path(spark, "ties")
    loads = spark.sparkContext.broadcast(shingle_loads(docs, size, total))  # 2 ** LOAD_BITS bytes at most
    ties = materialize(candidate_ties(docs, size, num, den, loads), "", tied)
    loads.unpersist()
    # Both graphs at once; a family is what has the same component in either.
    both = connected_components(ties, "rough", ["kind"]).groupBy(F.col("node").alias("k")).agg(*[F.min(F.when(F.col("kind") == i, F.col("component"))).alias(f"f{i}") for i in (0, 1)])
    rough = both.where("f0 is not null and f1 is not null").select("k", F.xxhash64("f0", "f1").alias("family"))
    families = connected_components(refined(sketched.join(rough, "k"), num, den), "families").select(F.col("node").alias("k"), F.col("component").alias("family"))
    drop_path(spark, tied)
    kept = new_path(spark, "family-members")
    inside = materialize(classes.join(families, "k").select("cls", "least_id", "least_t", "n", "family"), "", kept)
    sizes = inside.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = inside.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).withColumn("t", _text_key())
    # The same plan at every size: families grow with the input, so their side is never broadcast.
    held = dealt.hint("merge").join(texts, F.col("least_id").eqNullSafe(F.col("id")) & (F.col("least_t") == F.col("t"))).drop("id", "least_id", "t", "least_t")
    if repeated:  # rows that repeat id and text would stand for their class more than once
        held = held.dropDuplicates(["cls"])
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "text"
    )
    tasks = pairs.repartition(n, "family", "low", "high").sortWithinPartitions("family", "low", "high")
    links = connected_components(_links(tasks, size, num, den), "jaccard").select(F.col("node").alias("cls"), F.col("component"))
    labelled = materialize(classes.select("cls").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "labelled")
    drop_path(spark, kept)
    return members, labelled


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; sets link where intersection / union >= num / den."""
    members, labelled = _components(docs, size, num, den)
    ids = members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id")).join(labelled, "cls")
    names = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(names, "component").select(F.col("cls").alias("c"), "component_id")
    out = members.select("doc_id", "n_shingles", "cls").join(named, F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, with all their columns, that stay when one text of each component does: that of the smallest doc_id, and
    of rows that share it the one that a hash of the text puts first. Rows without an id come after all others. Rows
    are told apart by id and text: rows of one id whose texts aren't linked all stay, of equal rows one does. Rows of
    texts without words are linked with nothing and stay."""
    members, labelled = _components(docs, size, num, den)
    row = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    first = members.where("cls is not null").select("cls", row.alias("row")).groupBy("cls").agg(F.min("row").alias("row"))
    best = first.join(labelled, "cls").groupBy("component").agg(F.min("row").alias("row")).select("row.id", "row.t")
    wordless = members.where("cls is null").select(F.col("doc_id").alias("id"), "t").distinct()
    keep = best.unionByName(wordless)
    # The row itself travels as a struct, whatever its columns are called.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("row", "doc", _text_key().alias("key"))
    kept = keyed.join(keep, F.col("doc").eqNullSafe(F.col("id")) & (F.col("key") == F.col("t")), "left_semi")
    return kept.dropDuplicates(["doc", "key"]).select("row.*")
