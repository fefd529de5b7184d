"""Operator 7, suffix-array dedup: every byte that a long repeat covers goes from all documents but the first.

Strings of `LEAST` = 50 bytes that also start in a document of smaller doc_id are removed, byte by byte, by maximal
repeats of an enhanced suffix array.

1. Each 50-byte window belongs to its minimizer, the 18-byte string of least hash within it: equal windows have equal
   minimizers. Runs of windows with one minimizer form a context of 50 to 82 bytes.
2. A first pass tells, per document, the minimizers that other documents hold too; all others can't repeat.
3. Contexts of shared minimizers meet by minimizer. Equal ones, compared byte by byte, share a leaf with the list of
   their places. Over the leaves a suffix array is built, of the suffixes whose first 50 bytes repeat, with the array of
   common prefixes. A stack scan walks the tree of common-prefix intervals and keeps those with diverse left extensions:
   the maximal repeats, each with all of its occurrences, not neighbours alone. (A repeat that the same byte always
   precedes lies within a longer one.) A leaf of several places is an interval as well.
4. Every removal comes from such an interval: an occurrence goes if a smaller document holds the repeat. Decisions return
   to their documents as places, which merge them and put the remaining bytes together.

Hashes only bring bytes together: where they are equal, bytes are compared before anything follows from it.
`repeat_groups` gives the maximal repeats themselves.

Rows between the steps are compressed arrays, dealt by a hash of the minimizer or of the document; a task holds those of
its partition, so spark.sql.shuffle.partitions should grow with the input.

Defined results: null text is empty; matches never cross documents; repeats within one document, or among rows of one
doc_id, don't count; a null doc_id is larger than all others; texts of any length are read whole, in runs of a megabyte;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, trimmed
from .shingles import _BYTE, _power, mix

LEAST, GRAM = 50, 18
SPAN = LEAST - GRAM + 1  # 18-byte strings of a window
RUN = (1 << 20) - 256
#: Suffixes that are sorted together, in whole groups of one head.
SLAB = 100_000
NO_ID = np.iinfo(np.int64).max
_PLACE = np.uint64(0xFFFFF)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays]))


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, t) for t, b in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _hash_of(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def contexts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text, or part of a long one: its index, the places where contexts start and end (in the text), and the hash of
    each context's minimizer."""
    at = 0
    while at < len(texts):
        run, total, first = [], 0, at
        while at < len(texts) and (not run or total + len(texts[at]) < RUN):
            run.append(texts[at])
            total += len(run[-1]) + 1
            at += 1
        parts = [(first + i, 0, t) for i, t in enumerate(run)]
        if total > RUN:
            parts = [(first, s, run[0][s : s + RUN + LEAST - 1]) for s in range(0, max(1, len(run[0]) - LEAST + 1), RUN)]
        groups = [[p] for p in parts] if total > RUN else [parts]
        for group in groups:
            data = np.frombuffer(b"\n".join(p[2] for p in group), np.uint8)
            if len(data) < LEAST:
                continue
            sums, down = _prefix_sums(data)
            places = np.arange(len(data) - GRAM + 1)
            grams = _hash_of(sums, down, places, places + GRAM)
            low = (grams & ~_PLACE) | places.astype(np.uint64)
            for step in (1, 2, 4, 8, 16):
                low = np.minimum(low[:-step], low[step:])
            low = np.minimum(low[:-1], low[1:])  # 33 places in all
            chosen = (low & _PLACE).astype(np.int64)
            begin = 0
            for i, offset, t in group:
                n = len(t) - LEAST + 1
                if n > 0:
                    own = chosen[begin : begin + n]
                    cut = np.flatnonzero(np.diff(own, prepend=-1))
                    yield i, cut + offset, np.append(cut[1:], n) + LEAST - 1 + offset, grams[own[cut]]
                begin += len(t) + 1


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


_BLOB = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_BLOB)


def _split(buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of parallel arrays by bucket."""
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    edges = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(sorted_[a]), [x[order[a:b]] for x in arrays]


def _minimizers(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct minimizers of each document, by bucket."""
        for b in _slices(batches, 2000):
            rows, docs, hashes = b.column("row").to_numpy(zero_copy_only=False), [], []
            for i, _, _, grams in contexts(b.column("text").to_pylist()):
                u = np.unique(grams)
                hashes.append(u)
                docs.append(np.full(len(u), i, np.uint32))
            if hashes:
                h, d = np.concatenate(hashes), np.concatenate(docs)
                ids = _ids(b.column("doc_id"))
                out = []
                for k, (hh, dd) in _split((h % np.uint64(n)).astype(np.int64), h, d):
                    named, dd = np.unique(dd, return_inverse=True)
                    out.append((k, _pack(hh, dd.astype(np.uint16), rows[named], ids[named])))
                yield _blobs(out)

    return run


def _shared(n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all occurrences of this task's minimizers those that documents of several ids hold, by document."""
        hs, rs, ds = [], [], []
        for b in batches:
            for blob in b.column("blob").to_pylist():
                h, d, rows, ids = _unpack(blob)
                hs.append(h), rs.append(rows[d]), ds.append(ids[d])
        if not hs:
            return
        h, r, d = np.concatenate(hs), np.concatenate(rs), np.concatenate(ds)
        del hs, rs, ds
        order = np.argsort(h, kind="stable")
        h, r, d = h[order], r[order], d[order]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(d, edges) != np.maximum.reduceat(d, edges)
        keep = np.repeat(several, np.diff(np.append(edges, len(h))))
        h, r, d = h[keep], r[keep], d[keep]
        if len(h):
            yield _blobs([(k, _pack(rr, dd, hh)) for k, (rr, dd, hh) in _split(np.mod(r, n_docs), r, d, h)])

    return run


def _with_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Documents in small batches, each with the sorted notes of its bucket: rows come by bucket, notes (no text) first."""
    bucket, notes, blobs = None, (), []
    for b in _slices(batches):
        for key, at in _groups(b.column("bucket").to_numpy(zero_copy_only=False)):
            part = b.slice(at.start, at.stop - at.start)
            if key != bucket:
                bucket, notes, blobs = key, None, []
            told = [x for x in part.column("blob").to_pylist() if x is not None]
            if told:
                blobs += [_unpack(x) for x in told]
                notes = None
            if len(told) < part.num_rows:
                if notes is None:
                    cols = [np.concatenate(x) for x in zip(*blobs, strict=True)] if blobs else []
                    order = np.argsort(cols[0], kind="stable") if cols else None
                    notes, blobs = tuple(c[order] for c in cols), []
                yield part.slice(len(told)), notes


def _groups(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    for a, b in zip(edges, np.append(edges[1:], len(keys)), strict=True):
        yield int(keys[a]), slice(int(a), int(b))


def _noted(notes: tuple[np.ndarray, ...], row: int, doc_id: int) -> np.ndarray:
    """Which notes are a row's: those of its hash and its doc_id."""
    at = np.arange(np.searchsorted(notes[0], row, "left"), np.searchsorted(notes[0], row, "right"))
    return at[notes[1][at] == doc_id]


def _gather(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of shared minimizers by bucket; the bytes of equal ones of these documents once, with all places."""
        for b, notes in _with_notes(batches):
            if not notes:
                continue
            rows, ids = b.column("row").to_numpy(zero_copy_only=False), _ids(b.column("doc_id"))
            texts = b.column("text").to_pylist()
            grams_, docs, where = [], [], []
            for i, starts, ends, grams in contexts(texts):
                hit = np.flatnonzero(np.isin(grams, notes[2][_noted(notes, int(rows[i]), int(ids[i]))]))
                if len(hit):
                    grams_.append(grams[hit])
                    docs.append(np.full(len(hit), i, np.uint16)), where.append(np.stack([starts[hit], ends[hit]], 1))
            if not grams_:
                continue
            gram, doc, span = np.concatenate(grams_), np.concatenate(docs), np.concatenate(where)
            out = []
            for k, (dd, ss) in _split((gram % np.uint64(n)).astype(np.int64), doc, span):
                uniq: dict[bytes, int] = {}
                inverse = [uniq.setdefault(texts[i][a:z], len(uniq)) for i, (a, z) in zip(dd.tolist(), ss.tolist(), strict=True)]
                lens = np.array([len(x) for x in uniq], np.uint8)
                named, dd = np.unique(dd, return_inverse=True)
                out.append((k, _pack(lens, np.frombuffer(b"".join(uniq), np.uint8), np.array(inverse, np.uint32), dd.astype(np.uint16), rows[named], ids[named], ss[:, 0].astype(np.uint32))))
            yield _blobs(out)

    return run


def maximal_repeats(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, low: np.ndarray, several: np.ndarray | None = None) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Maximal repeats of at least LEAST bytes among distinct strings of data: length, the least of `low` over the
    strings that hold it, and all its occurrences as (string, offset). `several` marks strings that stand for several
    documents: repeats on their own."""
    several = np.zeros(len(starts), bool) if several is None else several
    windows = np.maximum(lens - LEAST + 1, 0)
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), windows)
    if not len(owner):
        return
    offset = (np.arange(len(owner)) - np.repeat(first, windows)).astype(np.uint8)
    head = np.empty(len(owner), np.uint64)
    begin = 0
    while begin < len(starts):  # hashes of the first 50 bytes, by runs of strings of a megabyte
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + (1 << 20))))
        span = slice(int(first[begin]), int(first[end - 1] + windows[end - 1]))
        base = int(starts[begin])
        sums, down = _prefix_sums(data[base : int(starts[end - 1] + lens[end - 1])])
        place = starts[owner[span]] + offset[span] - base
        head[span] = _hash_of(sums, down, place, place + LEAST)
        begin = end
    order = np.argsort(head, kind="stable")
    h = head[order]
    same = h[1:] == h[:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (several[owner[order]] & (offset[order] == 0))]
    del h, same
    if not len(order):
        return
    # What repeats, by slabs of whole groups of one head.
    groups = np.flatnonzero(np.concatenate([[True], head[order][1:] != head[order][:-1]]))
    cuts = groups[np.flatnonzero(np.diff(groups // SLAB, prepend=-1))].tolist()
    for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = order[a:z]
        yield from _scan(data, starts, lens, low, several, owner[at].astype(np.int64), offset[at].astype(np.int64), head[at])


def _true_heads(data: np.ndarray, place: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Names of the suffixes' first LEAST bytes: their hashes, or ranks of the bytes should a hash stand for several."""
    order = np.argsort(head, kind="stable")
    p, h = place[order], head[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    for j in range(LEAST):
        if (data[p[same] + j] != data[p[same + 1] + j]).any():
            rows = np.ascontiguousarray(data[place[:, None] + np.arange(LEAST)])
            return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)
    return head


def _scan(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, low: np.ndarray, several: np.ndarray, owner: np.ndarray, offset: np.ndarray, head: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """The stack scan over suffixes (owner, offset) whose heads repeat."""
    # The suffix array: by the first 50 bytes, then by the rest, whose bytes past the end count as less.
    place = starts[owner] + offset
    head = _true_heads(data, place, head)
    more = int(lens[owner].max()) - LEAST
    rest = lens[owner] - offset - LEAST
    tail = np.zeros((len(owner), max(1, -(-more // 8)) * 8), np.uint8)
    used = np.zeros(tail.shape, bool)
    for j in range(more):
        inside = j < rest
        used[inside, j] = True
        tail[inside, j] = data[place[inside] + LEAST + j]
    words = tail.view(">u8").astype(np.uint64)
    suffix = np.lexsort((rest, *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], head))
    owner, offset, head, place, tail, used = owner[suffix], offset[suffix], head[suffix], place[suffix], tail[suffix], used[suffix]
    equal = (tail[1:] == tail[:-1]) & used[1:] & used[:-1]
    common = np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1)) + LEAST
    common[head[1:] != head[:-1]] = 0
    lcp = [*common.tolist(), 0]
    who, off = owner.tolist(), offset.tolist()
    before = np.where(offset > 0, data[np.maximum(place - 1, 0)].astype(np.int64), -1).tolist()
    least = low[owner].tolist()
    whole = np.where(several[owner] & (offset == 0), lens[owner], 0).tolist()
    # Stack scan: (common prefix, first suffix, least document, left byte or None when diverse).
    stack: list[list] = []
    for i, now in enumerate(lcp):
        low_i, left = least[i], before[i] if before[i] >= 0 else None
        begin = i
        if whole[i] > now and whole[i] > (lcp[i - 1] if i else 0):  # a leaf of several documents
            yield whole[i], low_i, [(who[i], 0)]
        # Suffix i closes every interval of a longer common prefix than it shares with the next one.
        while stack and stack[-1][0] > now:
            length, begin, low_s, left_s = stack.pop()
            low_i, left = min(low_i, low_s), left if left == left_s else None
            if left is None:
                yield length, low_i, [(who[j], off[j]) for j in range(begin, i + 1)]
        if now >= LEAST:
            if stack and stack[-1][0] == now:
                top = stack[-1]
                top[2], top[3] = min(top[2], low_i), top[3] if top[3] == left else None
            else:
                stack.append([now, begin, low_i, left])


class _Contexts:
    """The distinct contexts of a task, and the places of each: context c, row r, document d, start p; sorted by c, d."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        leaves: dict[bytes, int] = {}
        cs, rs, ds, ps = [], [], [], []
        for b in batches:
            for blob in b.column("blob").to_pylist():
                sizes, text, inverse, dd, rows, ids, starts = _unpack(blob)
                raw, ends = text.tobytes(), np.cumsum(sizes, dtype=np.int64)
                local = np.array([leaves.setdefault(raw[e - s : e], len(leaves)) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64)
                cs.append(local[inverse]), rs.append(rows[dd]), ds.append(ids[dd]), ps.append(starts)
        empty = np.zeros(0, np.int64)
        c, r, d, p = (np.concatenate(x) if x else empty for x in (cs, rs, ds, ps))
        del cs, rs, ds, ps
        order = np.lexsort((d, c))
        self.c, self.r, self.d, self.p = c[order], r[order], d[order], p[order].astype(np.int64)
        self.edges = np.searchsorted(self.c, np.arange(len(leaves) + 1))
        self.sizes = np.array([len(x) for x in leaves], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(leaves), np.uint8)
        self.low = self.d[self.edges[:-1]] if len(leaves) else empty
        self.high = self.d[self.edges[1:] - 1] if len(leaves) else empty

    def repeats(self) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        return maximal_repeats(self.data, self.starts, self.sizes, self.low, self.low < self.high)


def _outermost(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(least document, start, end) of spans that don't lie within one of no greater document."""
    kept: list[tuple[int, int, int]] = []
    for least, a, z in sorted(spans, key=lambda x: (x[0], x[1] - x[2])):
        if not any(x <= a and z <= y for _, x, y in kept):
            kept.append((least, a, z))
    return kept


def _decide(n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By document the spans to remove, each of a context's start."""
        held = _Contexts(batches)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for length, least, places in held.repeats():
            for s, offset in places:
                if least < held.high[s]:
                    found.setdefault(s, []).append((least, offset, offset + length))
        begin, end, first, last = [], [], [], []
        for s, spans in found.items():
            lo, hi = int(held.edges[s]), int(held.edges[s + 1])
            for least, a, z in _outermost(spans):
                later = lo + int(np.searchsorted(held.d[lo:hi], least, "right"))  # larger documents lose it
                if later < hi:
                    begin.append(later), end.append(hi), first.append(a), last.append(z)
        if begin:
            begin, n = np.array(begin), np.array(end) - np.array(begin)
            at = _spread(begin, n)
            rows, a, z = held.r[at], np.repeat(np.array(first, np.uint8), n), np.repeat(np.array(last, np.uint8), n)
            starts = held.p[at].astype(np.uint32)
            yield _blobs([(k, _pack(*x)) for k, x in _split(np.mod(rows, n_docs), rows, held.d[at], starts, a, z)])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats that several documents hold: a row for each occurrence."""
    held = _Contexts(batches)
    schema = pa.schema([("repeat", pa.string()), ("length", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64())])
    for length, least, places in held.repeats():
        if least == max(int(held.high[s]) for s, _ in places):
            continue
        s, offset = places[0]
        name = hashlib.sha256(held.data[held.starts[s] + offset : held.starts[s] + offset + length].tobytes()).hexdigest()
        for s, offset in places:
            at = slice(int(held.edges[s]), int(held.edges[s + 1]))
            ids = held.d[at]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(name), n), pa.repeat(pa.scalar(length, pa.int32()), n), pa.array(ids, mask=ids == NO_ID), pa.array(held.p[at] + offset)], schema=schema
            )


def _cleaned(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, notes in _with_notes(batches):
            rows, texts = b.column("row").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            ids, gone = _ids(b.column("doc_id")), {}
            if notes:
                for i, r in enumerate(rows.tolist()):
                    at = _noted(notes, r, int(ids[i]))
                    if len(at):
                        start = notes[2][at].astype(np.int64)
                        gone[i] = start + notes[3][at], start + notes[4][at]
            out = []
            for i, text in enumerate(texts):
                kept, spans, removed = text, [], 0
                if i in gone:
                    a, z = gone[i]
                    order = np.argsort(a, kind="stable")
                    a, z = a[order], np.maximum.accumulate(z[order])
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                    a, z = a[new], z[np.append(new[1:], len(z)) - 1]
                    spans, removed = list(zip(a.tolist(), z.tolist(), strict=True)), int((z - a).sum())
                    edges = [0, *[x for s in spans for x in s], len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                row = (len(text), removed, len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [list(s) for s in spans]) if with_text else row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    return run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, spans array<array<bigint>>" * with_text


def _contexts_met(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Contexts of shared minimizers, dealt by minimizer, and a function that deals notes beside their documents."""
    n = shuffle_partitions(docs.sparkSession)
    n_docs = n
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    # A row is known by its doc_id and a hash of its text, so that rows of one doc_id stay apart; equal rows fare alike.
    base = base.withColumn("row", F.xxhash64("doc_id", F.sha2("text", 256)))
    blob = "bucket int, blob binary"
    seeds = base.mapInArrow(trimmed(_minimizers(n)), blob).repartitionById(n, F.col("bucket"))
    shared = materialize(seeds.mapInArrow(trimmed(_shared(n_docs)), blob), "shared-minimizers")
    rows = base.select(F.pmod("row", F.lit(n_docs)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "row", "doc_id", "text", F.lit(None).cast("binary").alias("blob"))

    def beside(notes: DataFrame) -> DataFrame:
        told = notes.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "blob")
        return rows.unionByName(told).repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket", "kind")

    return beside(shared).mapInArrow(trimmed(_gather(n)), blob).repartitionById(n, F.col("bucket")), beside


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with_text adds the kept bytes and the removed spans."""
    found, beside = _contexts_met(docs)
    decided = materialize(found.mapInArrow(trimmed(_decide(shuffle_partitions(docs.sparkSession))), "bucket int, blob binary"), "removed-spans")
    run, schema = _cleaned(with_text)
    return beside(decided).mapInArrow(trimmed(run), schema)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """repeat (SHA-256 of its bytes), length, doc_id, start: a row for each occurrence of each maximal repeat of at least
    LEAST bytes that documents of several ids hold. Repeats longer than a context come as a chain of overlapping ones."""
    found, _ = _contexts_met(docs)
    return found.mapInArrow(trimmed(_grouped), "repeat string, length int, doc_id bigint, start bigint")
