"""Operator 2, token-ID output: a content-addressed store of encoded documents.

A rolling hash over the ids cuts each document into chunks where its content says so, so that equal passages give equal
chunks. A chunk's address is the BLAKE2b digest of its bytes. The store is three Parquet tables in the shared folder,
written by Spark's committers, so that a task that is run again leaves no double:

- packs:    bucket, hashes, sizes, root, payload. Unique chunks, each stored once; payload is Zstandard over the
            little-endian ids (16 bits where the vocabulary allows, else 32), root the Merkle root over the hashes.
- recipes:  part, place, doc_id, start, n_tokens, hashes, root. Documents in ascending doc_id order, by part and place.
- parts:    part, base, n_docs, n_tokens, digest. Ids before each part, from which start in recipes counts; digest stands
            for the set of the part's recipes.
- store:    n_parts, n_docs, n_tokens, root. One row: the Merkle root over the parts' digests.

Reading back checks every chunk's address, every Merkle root, of packs, documents and the store, and that no recipe is
lost, doubled or changed; it raises on any mismatch.

Defined results: null text is empty and gives the end id alone; null doc_ids come first; rows that share a doc_id are
documents of their own, in order of their chunks; texts of any length are encoded whole; an empty table gives empty
tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize, new_path, shuffle_partitions, trimmed
from .tokens import MOST_PIECES, default_tokenizer, encoder

DIGEST = 16
#: Chunks hold between these numbers of ids, and about 1024 between cuts.
LEAST, MOST, MASK = 256, 8192, np.uint64(1023)
PACK_BYTES = 1 << 20
#: Ids that a task holds back to fill packs.
HELD_BYTES = 12 << 20
_WINDOW = 8

_STAGED = "is_pack boolean, doc_id bigint, n_tokens bigint, hashes binary, sizes binary, bucket int, payload binary"
_PACK = "bucket int, hashes binary, sizes binary, root binary, payload binary"
_PART = "part int, base bigint, n_docs bigint, n_tokens bigint, digest binary"
_STORE = "n_parts int, n_docs bigint, n_tokens bigint, root binary"
_RECIPE = "part int, place bigint, doc_id bigint, start bigint, n_tokens bigint, hashes binary, root binary"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(hashes: bytes) -> bytes:
    """Root over concatenated digests; an odd one out moves up as it is. Leaves and inner nodes hash under different tags."""
    level = [_digest(b"\0" + hashes[i : i + DIGEST]) for i in range(0, len(hashes), DIGEST)]
    while len(level) > 1:
        level = [_digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else _digest(b"")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the content asks for a cut: the hash of the last eight ids has ten zero bits."""
    n = len(ids)
    if n < _WINDOW:
        return np.zeros(0, np.int64)
    v = _mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    h = v[_WINDOW - 1 :].copy()
    for j in range(1, _WINDOW):
        h *= np.uint64(3)
        h += v[_WINDOW - 1 - j : n - j]
    return np.flatnonzero((_mix(h) & MASK) == 0) + _WINDOW


def chunk_ends(wished: list[int], n: int) -> list[int]:
    """Ends of a document's chunks within the bounds of length, from the places where its content asks for cuts."""
    ends, last = [], 0
    for at in [*wished, n]:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at > last and (at - last >= LEAST or at == n):
            ends.append(at)
            last = at
    return ends


class _Packs:
    """Gathers chunks by bucket and gives packs of bounded size."""

    def __init__(self, most: int):
        self.most, self.held, self.zstd = most, {}, zstandard.ZstdCompressor(level=2)

    def add(self, bucket: int, digest: bytes, data: bytes) -> tuple | None:
        entry = self.held.setdefault(bucket, [[], [], [], 0])
        entry[0].append(digest)
        entry[1].append(len(data))
        entry[2].append(data)
        entry[3] += len(data)
        return self.take(bucket) if entry[3] >= self.most else None

    def take(self, bucket: int) -> tuple:
        hashes, sizes, data, _ = self.held.pop(bucket)
        return bucket, b"".join(hashes), np.array(sizes, "<i4").tobytes(), self.zstd.compress(b"".join(data))

    def rest(self) -> Iterator[tuple]:
        for bucket in list(self.held):
            yield self.take(bucket)

    def size(self) -> int:
        return sum(x[3] for x in self.held.values())


def _unpack(hashes: bytes, sizes: bytes, payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    data, at = zstandard.ZstdDecompressor().decompress(payload), 0
    for i, n in enumerate(np.frombuffer(sizes, "<i4").tolist()):
        yield hashes[i * DIGEST : (i + 1) * DIGEST], data[at : at + n]
        at += n


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, most_pieces: int = MOST_PIECES) -> str:
    """Writes the store of all documents and returns its path. most_pieces bounds the cache of each Python worker."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    tokenizer = tokenizer or default_tokenizer()
    n = shuffle_partitions(spark)
    buckets = n
    schema = pa.schema([("is_pack", pa.bool_()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("bucket", pa.int32()), ("payload", pa.binary())])

    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, most=most_pieces)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 65536 else "<u4"
        seen: set[bytes] = set()  # of this task: copies in one task leave it once
        packs = _Packs(PACK_BYTES)
        for batch in batches:
            rows, doc_ids = [], iter(batch.column(0).to_pylist())
            for flat, ends in enc.encode_flat(batch.column(1)):
                flat = np.insert(flat.astype(kind), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                wished, begin = marks(flat), 0
                bounds = np.searchsorted(wished, np.concatenate([[0], ends]) + _WINDOW)
                data = flat.tobytes()
                width = flat.itemsize
                for end, a, b in zip(ends.tolist(), bounds, np.append(bounds[1:], len(wished)), strict=False):
                    own = wished[a:b]
                    own = (own[own < end] - begin).tolist()
                    last, hashes = 0, []
                    for cut in chunk_ends(own, end - begin):
                        piece = data[(begin + last) * width : (begin + cut) * width]
                        last = cut
                        h = _digest(piece)
                        hashes.append(h)
                        if h not in seen:
                            seen.add(h)
                            if full := packs.add(int.from_bytes(h[:4], "little") % buckets, h, piece):
                                rows.append((True, None, None, full[1], full[2], full[0], full[3]))
                    rows.append((False, next(doc_ids), end - begin, b"".join(hashes), None, None, None))
                    begin = end
            if len(seen) > 500_000:
                seen.clear()
            if packs.size() > HELD_BYTES:
                rows += [(True, None, None, h, s, b, p) for b, h, s, p in packs.rest()]
            if rows:
                yield batch_of(rows)
        if rows := [(True, None, None, h, s, b, p) for b, h, s, p in packs.rest()]:
            yield batch_of(rows)

    staged_path = new_path(spark, "token-stage")
    staged = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(encode, encodes=True), _STAGED), "", staged_path)

    pack_schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("root", pa.binary()), ("payload", pa.binary())])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        packs = _Packs(PACK_BYTES)
        pack_of = lambda x: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((x[0], x[1], x[2], merkle_root(x[1]), x[3]), pack_schema, strict=True)], schema=pack_schema)
        for batch in batches:
            for bucket, hashes, sizes, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for h, data in _unpack(hashes, sizes, payload):
                    if h not in seen:
                        seen.add(h)
                        # Packs of a reduce task join its buckets: equal chunks have met here already.
                        if full := packs.add(0, h, data):
                            yield pack_of((bucket, *full[1:]))
        for full in packs.rest():
            yield pack_of(full)

    dealt = staged.where("is_pack").select("bucket", "hashes", "sizes", "payload").repartitionById(n, F.col("bucket"))
    materialize(dealt.mapInArrow(trimmed(unique, encodes=True), _PACK), "", f"{path}/packs")

    recipe_schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.binary()), ("root", pa.binary())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            lens, k = batch.column(1).to_numpy(zero_copy_only=False), batch.num_rows
            ends = start + np.cumsum(lens)
            roots = [merkle_root(h) for h in batch.column(2).to_pylist()]
            cols = [np.full(k, part, np.int32), np.arange(place, place + k), batch.column(0), ends - lens, lens, batch.column(2), roots]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, recipe_schema, strict=True)], schema=recipe_schema)
            place, start = place + k, int(ends[-1]) if k else start

    ordered = staged.where("not is_pack").select("doc_id", "n_tokens", "hashes").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "hashes")
    recipes = materialize(ordered.mapInArrow(trimmed(placed, encodes=True), _RECIPE), "", f"{path}/recipes")
    base, parts = 0, []
    for part, n_docs, n_tokens, digest in _part_digests(recipes):
        parts.append((part, base, n_docs, n_tokens, digest))
        base += n_tokens
    materialize(spark.createDataFrame(parts, _PART).coalesce(1), "", f"{path}/parts")
    whole = (len(parts), sum(p[2] for p in parts), base, merkle_root(b"".join(p[4] for p in parts)))
    materialize(spark.createDataFrame([whole], _STORE).coalesce(1), "", f"{path}/store")
    drop_path(spark, staged_path)
    return path


def _part_digests(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """part, n_docs, n_tokens and digest of each part, a row for each partition of the store. A digest covers the set of the
    part's recipes, each by its place, id, length and root."""
    said = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "part", "place", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", "root"))
    rows = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("n"), said(1).alias("a"), said(2).alias("b")).collect()
    return sorted((r["part"], r["docs"], r["n"], np.array([r["a"], r["b"]], ">i8").tobytes()) for r in rows)


def verify_store(spark: SparkSession, path: str) -> bytes:
    """The store's root, after its recipes have been found to be those that were written."""
    held = sorted((r["part"], r["n_docs"], r["n_tokens"], bytes(r["digest"])) for r in _table(spark, path, "parts", _PART).collect())
    whole = _table(spark, path, "store", _STORE).head()
    if whole is None or merkle_root(b"".join(p[3] for p in held)) != bytes(whole["root"]):
        raise ValueError("the parts don't match the store's Merkle root")
    if _part_digests(_table(spark, path, "recipes", _RECIPE)) != held:
        raise ValueError("the recipes don't match the digests of their parts")
    return bytes(whole["root"])


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with starts over the whole store; each Merkle root is checked where the hashes are exploded."""
    verify_store(spark, path)
    parts = _table(spark, path, "parts", _PART).select("part", "base")  # a row for each partition: small
    r = _table(spark, path, "recipes", _RECIPE).join(F.broadcast(parts), "part")
    return r.withColumn("start", F.col("start") + F.col("base")).drop("base")


def _exploded(recipes: DataFrame) -> DataFrame:
    names = ["part", "place", "doc_id", "start", "n_tokens", "seq", "hash"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column("hashes").to_pylist()
            for h, root in zip(hashes, b.column("root").to_pylist(), strict=True):
                if merkle_root(h) != root:
                    raise ValueError("a recipe's Merkle root doesn't match its chunks")
            counts = np.array([len(h) // DIGEST for h in hashes], np.int64)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            seq = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = [h[i : i + DIGEST] for h in hashes for i in range(0, len(h), DIGEST)]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at).cast(t) for c, t in zip(names[:5], types, strict=False)], pa.array(seq, pa.int32()), pa.array(flat, pa.binary())], schema=schema)

    return recipes.mapInArrow(trimmed(run, encodes=True), "part int, place bigint, doc_id bigint, start bigint, n_tokens bigint, seq int, hash binary")


def _chunks(spark: SparkSession, path: str, payload: bool, wide: bool) -> DataFrame:
    """hash, n and crc of each stored chunk, from its bytes; with payload, the ids too. wide: ids have 32 bits."""
    fields = [("hash", pa.binary()), ("n", pa.int32()), ("crc", pa.int64())] + [("ids", pa.binary())] * payload
    schema, kind = pa.schema(fields), "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, sizes, root, packed in zip(*[b.column(c).to_pylist() for c in ("hashes", "sizes", "root", "payload")], strict=True):
                if merkle_root(hashes) != root:
                    raise ValueError("a pack's Merkle root doesn't match its chunks")
                rows = []
                for h, data in _unpack(hashes, sizes, packed):
                    if _digest(data) != h:
                        raise ValueError("a chunk's bytes don't match its address")
                    ids = np.frombuffer(data, kind).astype("<u4")
                    rows.append((h, len(ids), zlib.crc32(ids.tobytes()), *([ids.tobytes()] * payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _table(spark, path, "packs", _PACK).mapInArrow(trimmed(run, encodes=True), "hash binary, n int, crc bigint" + ", ids binary" * payload)


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    p = 0
    while b:
        if b & 0x80000000:
            p ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (_POLY if a & 1 else 0)
    return p


_shifts: dict[int, int] = {}


def _shift(n: int) -> int:
    """x ** (8 * n)."""
    if n not in _shifts:
        if len(_shifts) > 100_000:
            _shifts.clear()
        out, square, k = 0x80000000, 0x00800000, n
        while k:
            if k & 1:
                out = _times(out, square)
            square, k = _times(square, square), k >> 1
        _shifts[n] = out
    return _shifts[n]


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of concatenated byte strings from the CRC-32 and length of each."""
    crc = 0
    for c, n in parts:
        crc = _times(crc, _shift(n)) ^ c
    return crc


def read_summary(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32, n_chunks. Only digests and counts are shuffled."""
    pieces = _exploded(_recipes(spark, path)).join(_chunks(spark, path, False, wide), "hash", "left")
    grouped = pieces.groupBy("part", "place", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc"))).alias("chunks"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, counts = [], []
            for n, chunks in zip(b.column("n_tokens").to_pylist(), b.column("chunks").to_pylist(), strict=True):
                if any(c["n"] is None for c in chunks) or sum(c["n"] for c in chunks) != n:
                    raise ValueError("a document's chunks are not all in the store")
                crcs.append(joined_crc([(c["crc"], 4 * c["n"]) for c in chunks]))
                counts.append(len(chunks))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(counts, pa.int32())], schema=schema)

    return grouped.mapInArrow(trimmed(run, encodes=True), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_chunks int")


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start and ids of each document, rebuilt from its chunks."""
    pieces = _exploded(_recipes(spark, path)).join(_chunks(spark, path, True, wide), "hash")
    grouped = pieces.groupBy("part", "place", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("chunks"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(c["ids"] for c in chunks), "<u4").astype(np.int64) for chunks in b.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], schema=schema)

    return grouped.mapInArrow(trimmed(run, encodes=True), "doc_id bigint, start bigint, ids array<bigint>")


def token_store(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Writes the store and gives the summary that its files hold."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    path = write_store(docs, None, tokenizer, end_id, most_pieces)
    wide = max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 65536
    return read_summary(spark, path, wide)
