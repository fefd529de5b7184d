"""A stored lexical index of immutable segments, and BM25 over it with blocks skipped against a running threshold.

A segment deals its documents by a hash of their id into shards of some thousands, each ordered by length. A row of the
index is one shard: its documents, and for each of its terms the list of places and counts. A list is cut into blocks of
RANGE places, each with the greatest count and the least length, from which the greatest weight follows for whatever
statistics the index then has. Beside the shards lie the documents as their terms, for merges and for vectors of them.

Added documents make a new segment; those of ids that the index has, and deleted ones, leave tombstones, which searches and
statistics heed. Segments of like size are merged once there are enough, without reading texts again. A version names the
live segments and tombstones; it is a file that must not exist yet, so of two writers one has to start again.

A search reads the shards where they lie and shuffles nothing of them. A task scores one shard at a time: the bounds of a query's blocks
sum up to one for each range of places, and ranges go from the highest bound down until what is left can't reach the
query's k best so far. A document's score is whole in its task; only each task's best rows are shuffled.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import porter
from ..functions.text import STOP_WORDS, or_empty
from ..llm.common import small_batches, trimmed
from ..storage import file_system, materialize, released_shuffles
from .dense import NONE
from .retrieval import small, top_k

SHARD_DOCS = 2048
RANGE = 8
#: Segments of one size tier, each four times the one before, that are merged.
TIER = 4
#: Terms of queries that go to every task at once.
BLOCK_TERMS = 2_000_000
#: Up to this many ids of a filter go to every task at once; more are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Documents that a task analyses at once.
ANALYSED = 250
K1, B = 1.2, 0.75
_TOKEN = re.compile("[a-z0-9]+")
DOC = "doc_id bigint, digest bigint, dl int, terms array<string>, tfs array<int>"
PLACED = "segment string, shard int, doc_id bigint, place int, dl int, digest bigint"
SHARDS = "segment string, shard int, ids array<bigint>, dls array<int>, digests array<bigint>, terms array<string>, ends array<int>, places array<int>, tfs array<int>"
_SHARD_FIELDS = [f.split()[0] for f in SHARDS.split(", ")]


@dataclass(frozen=True)
class Lexicon:
    """An open version of an index: where it lies and what it says of itself."""

    spark: SparkSession
    path: str
    meta: dict

    def documents(self) -> DataFrame:
        """segment, shard, doc_id, place, dl, digest of live documents."""
        one = F.posexplode(F.arrays_zip("ids", "dls", "digests")).alias("place", "x")
        every = self.shards().select("segment", "shard", one)
        every = every.select("segment", "shard", F.col("x.ids").alias("doc_id"), "place", F.col("x.dls").alias("dl"), F.col("x.digests").alias("digest"))
        return every.join(self.gone().select("segment", "doc_id"), ["segment", "doc_id"], "left_anti") if self.meta["gone"] else every

    def shards(self) -> DataFrame:
        if not self.meta["segments"]:
            return self.spark.createDataFrame([], SHARDS)
        return self.spark.read.schema(SHARDS).parquet(*[f"{self.path}/{s['id']}/shards" for s in self.meta["segments"]])

    def analysed(self) -> DataFrame:
        """Live documents as their terms and counts."""
        every = self.spark.createDataFrame([], DOC)
        for s in self.meta["segments"]:
            held = self.spark.read.schema(DOC).parquet(f"{self.path}/{s['id']}/terms")
            if self.meta["gone"]:
                held = held.join(self.gone().where(F.col("segment") == s["id"]).select("doc_id"), "doc_id", "left_anti").select(*held.columns)
            every = every.unionByName(held)
        return every

    def gone(self) -> DataFrame:
        if not self.meta["gone"]:
            return self.spark.createDataFrame([], PLACED)
        held = self.spark.read.schema(PLACED).parquet(*[f"{self.path}/{g}" for g in self.meta["gone"]])
        return held.where(F.col("segment").isin([s["id"] for s in self.meta["segments"]]))


# ---- segments


def _lower(text: str) -> str:
    """Lower case as functions.text.lower has it, as far as tokens tell: a dotted capital I is one character."""
    return text.replace("\u0130", "i").lower()


def tokens(text: str | None, stemmed: bool) -> list[str]:
    words = _TOKEN.findall(_lower(text or ""))
    return [porter(w) for w in words if w not in _STOP] if stemmed else words


_STOP = frozenset(STOP_WORDS)


def analysed(docs: DataFrame, doc_id: str, text: Column, stemmed: bool) -> DataFrame:
    """Documents as their distinct terms and counts, with the hash by which an edit shows."""
    spark = docs.sparkSession
    small_batches(spark)
    # A table of few files is read by few tasks; its texts are dealt to all of them first.
    if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("bigint"), or_empty(text)).alias("digest"), or_empty(text).alias("text"))

    def go(batches):
        stems: dict[str, str] = {}
        for b in (x.slice(i, ANALYSED) for x in batches for i in range(0, len(x), ANALYSED)):
            dls, terms, tfs, ends = [], [], [], [0]
            for t in b.column("text").to_pylist():
                words = _TOKEN.findall(_lower(t))
                if stemmed:
                    words = [stems.get(w) or stems.setdefault(w, porter(w)) for w in words if w not in _STOP]
                    if len(stems) > 200_000:
                        stems.clear()
                count = Counter(words)
                dls.append(len(words))
                terms += count.keys()
                tfs += count.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(dls, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                names=["doc_id", "digest", "dl", "terms", "tfs"],
            )

    return rows.mapInArrow(trimmed(go), DOC)


def shard_of(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def _packed(rows: list[pa.RecordBatch], name: str, shard: int) -> pa.RecordBatch:
    """A shard as a row: its documents in order of length (ids, lengths, hashes), its terms, and their lists, one after the
    other, with their ends."""
    table = pa.Table.from_batches(rows).combine_chunks()
    dl = table.column("dl").to_numpy()
    order = np.lexsort((table.column("doc_id").to_numpy(), dl))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    lists = table.column("terms").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    code, places = coded.indices.to_numpy(), np.repeat(place, sizes)
    tfs = table.column("tfs").combine_chunks().flatten().to_numpy()
    by = np.lexsort((places, code))
    code, places, tfs = code[by], places[by], tfs[by]
    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code)) if len(code) else np.zeros(0)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
    held = [table.column("doc_id").to_numpy()[order], dl[order].astype(np.int32), table.column("digest").to_numpy()[order], coded.dictionary, ends.astype(np.int32), places, tfs.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int32()), *[one(x) for x in held]], names=_SHARD_FIELDS)


def _write_segment(docs: DataFrame, path: str) -> dict:
    """Writes a segment of analysed documents, as their terms and by shards, and tells what it holds."""
    spark, name = docs.sparkSession, f"segment-{uuid.uuid4().hex}"
    small_batches(spark)
    docs = materialize(docs, "", f"{path}/{name}/terms")
    numbers = _numbers(docs)
    shards = max(1, -(-numbers["rows"] // SHARD_DOCS))
    dealt = docs.withColumn("shard", shard_of(F.col("doc_id"), shards)).repartition("shard").sortWithinPartitions("shard")

    def go(batches):
        for shard, rows in _runs(batches, "shard"):
            yield _packed([r.drop_columns("shard") for r in rows], name, shard)

    with released_shuffles(spark):
        # A row is some megabytes, so a row group holds few of them, and so does a reader.
        packed = dealt.mapInArrow(trimmed(go), SHARDS).write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).option("parquet.page.size.row.check.min", "1")
        packed.parquet(f"{path}/{name}/shards")
    return {"id": name, "shards": shards, **numbers}


def _runs(batches, *keys: str):
    """Runs of rows with equal keys, in their order, as lists of batches."""
    now, held = None, []
    for b in batches:
        columns = [b.column(k).to_pylist() for k in keys]
        at = list(zip(*columns, strict=True)) if len(keys) > 1 else columns[0]
        start = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[start]:
                if held and at[start] != now:
                    yield now, held
                    held = []
                now = at[start]
                held.append(b.slice(start, i - start))
                start = i
    if held:
        yield now, held


# ---- versions


class Conflict(Exception):
    """Another writer has made the next version."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = file_system(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _commit(spark: SparkSession, path: str, meta: dict) -> Lexicon:
    fs, p = file_system(spark, f"{path}/versions/{meta['version']:08d}")
    if fs.exists(p):
        raise Conflict(path)
    part = file_system(spark, f"{path}/writing-{uuid.uuid4().hex}")[1]
    for target, content in ((part, json.dumps(meta)),):
        out = fs.create(target, False)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
    fs.mkdirs(p.getParent())
    if fs.exists(p) or not fs.rename(part, p):
        raise Conflict(path)
    return Lexicon(spark, path, meta)


def open_lexicon(spark: SparkSession, path: str, stemmed: bool | None = None) -> Lexicon | None:
    """The last version at a path, if there is one, and it has the wanted form."""
    versions = _versions(spark, path)
    if not versions:
        return None
    meta = json.loads(spark.read.text(f"{path}/versions/{versions[-1]:08d}", wholetext=True).head()["value"])
    return Lexicon(spark, path, meta) if stemmed is None or meta["stemmed"] == stemmed else None


def _numbers(docs: DataFrame) -> dict:
    one = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum("dl").alias("tokens"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest")).first()
    return {"rows": one["rows"], "tokens": one["tokens"] or 0, "digest": int(one["digest"] or 0)}


def create(docs: DataFrame, doc_id: str, text: Column, path: str, stemmed: bool = False) -> Lexicon:
    """A new index of all documents. Ids are distinct and not null; other rows are no documents."""
    spark = docs.sparkSession
    segment = _write_segment(analysed(docs.where(F.col(doc_id).isNotNull()), doc_id, text, stemmed), path)
    return _commit(spark, path, {"version": max(_versions(spark, path), default=0) + 1, "stemmed": stemmed, "segments": [segment], "gone": [], **{k: segment[k] for k in ("rows", "tokens", "digest")}})


def change(index: Lexicon, added: DataFrame | None = None, doc_id: str = "doc_id", text: Column | None = None, deleted: DataFrame | None = None) -> Lexicon:
    """The next version: documents added, or replaced where the index has their id, and ids (doc_id) deleted."""
    spark, meta = index.spark, dict(index.meta)
    ids, segments = [], list(meta["segments"])
    if added is not None:
        segment = _write_segment(analysed(added.where(F.col(doc_id).isNotNull()), doc_id, text if text is not None else F.col("text"), meta["stemmed"]), index.path)
        segments.append(segment)
        ids.append(spark.read.schema(DOC).parquet(f"{index.path}/{segment['id']}/terms").select("doc_id"))
        for k in ("rows", "tokens", "digest"):
            meta[k] += segment[k]
    if deleted is not None:
        ids.append(deleted.select(F.col("doc_id").cast("bigint").alias("doc_id")))
    name = f"gone-{meta['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
    lost = index.documents().join(reduce(DataFrame.unionByName, ids).distinct(), "doc_id", "left_semi")
    lost.select(*[f.split()[0] for f in PLACED.split(", ")]).write.parquet(f"{index.path}/{name}")
    less = _numbers(spark.read.parquet(f"{index.path}/{name}"))
    for k in ("rows", "tokens", "digest"):
        meta[k] -= less[k]
    gone = meta["gone"] + ([name] if less["rows"] else [])
    return merge(_commit(spark, index.path, meta | {"version": meta["version"] + 1, "segments": segments, "gone": gone}))


def fresh(index: Lexicon, docs: DataFrame, doc_id: str, text: Column) -> bool:
    """Whether the index holds exactly these documents, with these texts."""
    held = docs.where(F.col(doc_id).isNotNull())
    now = held.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(F.col(doc_id).cast("bigint"), or_empty(text)).cast("decimal(38,0)")).alias("digest")).first()
    return (index.meta["rows"], index.meta["digest"]) == (now["rows"], int(now["digest"] or 0))


def sync(index: Lexicon, docs: DataFrame, doc_id: str, text: Column) -> Lexicon:
    """The index brought to the state of a table: only documents that are new or whose text was edited are analysed."""
    if fresh(index, docs, doc_id, text):
        return index
    source = docs.where(F.col(doc_id).isNotNull()).withColumns({"__id": F.col(doc_id).cast("bigint"), "__digest": F.xxhash64(F.col(doc_id).cast("bigint"), or_empty(text))})
    held = materialize(index.documents().select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")), "held")
    added = source.join(held, ["__id", "__digest"], "left_anti")
    deleted = held.join(source.select("__id"), "__id", "left_anti").select(F.col("__id").alias("doc_id"))
    return change(index, added, doc_id, text, deleted)


def merge(index: Lexicon, everything: bool = False) -> Lexicon:
    """Merges segments of like size, and those that are mostly tombstones, into one, until none are left; or everything.
    Texts aren't read again."""
    lost = {}
    if index.meta["gone"]:
        lost = {r["segment"]: r["n"] for r in index.gone().groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiers: dict[int, list[dict]] = {}
    for s in index.meta["segments"]:
        tiers.setdefault((max(s["rows"], 1).bit_length() - 1) // 2, []).append(s)
    chosen = [s for group in tiers.values() if len(group) >= TIER for s in group]
    chosen += [s for s in index.meta["segments"] if s not in chosen and 2 * lost.get(s["id"], 0) > s["rows"]]
    if everything and (len(index.meta["segments"]) > 1 or lost):
        chosen = index.meta["segments"]
    if not chosen:
        return index
    names = [s["id"] for s in chosen]
    part = Lexicon(index.spark, index.path, index.meta | {"segments": chosen})
    merged = _write_segment(part.analysed(), index.path)
    kept = [s for s in index.meta["segments"] if s["id"] not in names] + ([merged] if merged["rows"] else [])
    gone = index.meta["gone"] if any(lost.get(s["id"]) for s in kept) else []
    done = _commit(index.spark, index.path, index.meta | {"version": index.meta["version"] + 1, "segments": kept, "gone": gone})
    return done if everything else merge(done)


# ---- shards in tasks


def _beside(index: Lexicon, allowed: DataFrame | None = None, *columns: str) -> DataFrame:
    """Shards (or some columns of them) where they lie, with places of tombstones, at most as many as a shard has documents,
    and ids that a filter allows."""
    small_batches(index.spark)
    rows = index.shards().select(*(columns or _SHARD_FIELDS))
    if index.meta["gone"]:
        lost = index.gone().groupBy("segment", "shard").agg(F.collect_set("place").alias("gone"))
        rows = rows.join(F.broadcast(lost) if len(index.meta["segments"]) and sum(s["rows"] for s in index.meta["segments"]) <= BROADCAST_IDS else lost.hint("merge"), ["segment", "shard"], "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    if allowed is None:
        return rows.withColumn("allowed", F.lit(None).cast("array<bigint>"))
    ids = allowed.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    held = index.spark.createDataFrame([], "segment string, shard int, allowed array<bigint>")
    for s in index.meta["segments"]:
        of = ids.select(F.lit(s["id"]).alias("segment"), shard_of(F.col("doc_id"), s["shards"]).alias("shard"), "doc_id")
        held = held.unionByName(of.groupBy("segment", "shard").agg(F.collect_list("doc_id").alias("allowed")))
    return rows.join(F.broadcast(held) if few else held.hint("merge"), ["segment", "shard"], "left")


@dataclass
class _Shard:
    """A shard in a task: its documents' ids, lengths and digests by place, which of them count, and lists of terms."""

    ids: np.ndarray
    dl: np.ndarray
    digests: np.ndarray
    live: np.ndarray
    lists: list[tuple]


def _shards(batches, filtered: bool = False, wanted: pa.Array | None = None):
    """Shards of batches of _beside, with the lists of some terms, or of all."""
    for b in batches:
        for r in range(len(b)):
            array = lambda name, i=r, held=b: held.column(name)[i].values
            numbers = lambda name: array(name).to_numpy(zero_copy_only=False)
            ids, dl, terms, ends, places, tfs = numbers("ids"), numbers("dls"), array("terms"), numbers("ends"), numbers("places"), numbers("tfs")
            live = np.ones(len(ids), bool)
            if array("gone") is not None:
                live[numbers("gone")] = False
            if filtered:
                live &= np.isin(ids, numbers("allowed")) if array("allowed") is not None else False
            at = np.arange(len(terms)) if wanted is None else np.flatnonzero(pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False))
            begins = np.append(0, ends[:-1])
            lists = [(t, places[i:j], tfs[i:j], *_blocks(places[i:j], tfs[i:j], dl)) for t, i, j in zip(terms.take(pa.array(at)).to_pylist(), begins[at].tolist(), ends[at].tolist(), strict=True)]
            yield _Shard(ids, dl, numbers("digests"), live, lists)


def _blocks(places: np.ndarray, tfs: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the blocks of a list end, the greatest count and the least length of each."""
    edge = np.flatnonzero(np.diff(places // RANGE, prepend=-1))
    return np.append(edge[1:], len(places)), np.maximum.reduceat(tfs, edge), np.minimum.reduceat(dl[places], edge)


def postings(index: Lexicon, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf, dl of live documents; of some terms (term) only, if given."""
    each = index.analysed().select("doc_id", F.col("dl").cast("bigint").alias("dl"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    each = each.select(F.col("x.terms").alias("term"), "doc_id", F.col("x.tfs").cast("bigint").alias("tf"), "dl")
    return each if terms is None else each.join(small(terms.select("term").distinct()), "term", "left_semi")


def counts(index: Lexicon, terms: list[str]) -> DataFrame:
    """term, n: how many live documents have each of some terms; those that none has are absent."""
    wanted = pa.array(terms, pa.string())
    gone = bool(index.meta["gone"])
    columns = ["segment", "shard", "terms", "ends", *(["places"] if gone else [])]

    def go(batches):
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for r in range(len(b)):
                ends = b.column("ends")[r].values.to_numpy()
                found = pc.index_in(b.column("terms")[r].values, value_set=wanted)
                at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                begins, n = np.append(0, ends[:-1])[at], ends[at]
                if gone and b.column("gone")[r].is_valid:
                    places = b.column("places")[r].values.to_numpy()
                    lost = np.append(0, np.cumsum(np.isin(places, b.column("gone")[r].values.to_numpy())))
                    n = n - (lost[ends[at]] - lost[begins])
                total[found.take(pa.array(at)).to_numpy()] += n - begins
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([wanted.take(pa.array(some)), pa.array(total[some])], names=["term", "n"])

    return _beside(index, None, *columns).mapInArrow(go, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def terms_of_documents(index: Lexicon) -> DataFrame:
    """doc_id, terms, tfs of live documents."""
    return index.analysed().select("doc_id", "terms", "tfs")


# ---- search


def _asked(queries: DataFrame, stemmed: bool) -> DataFrame:
    """query_id, terms: the distinct terms of each query."""

    def go(batches):
        for b in batches:
            terms = [list(dict.fromkeys(tokens(q, stemmed))) for q in b.column("query").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(terms, pa.list_(pa.string()))], names=["query_id", "terms"])

    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").cast("string").alias("query")).mapInArrow(go, "query_id bigint, terms array<string>")


class _Top:
    """The k best documents of each query so far, scores in millionths."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, [NONE] * queries
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * queries

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.least[query]
        scores, ids = (np.concatenate(x) for x in zip(self.held[query], (scores[fits], ids[fits]), strict=True))
        if len(ids) >= self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
            self.least[query] = int(scores[-1])
        self.held[query] = scores, ids


def _weighed(s: _Shard, numbers: dict[str, int], idf: dict[str, float], avgdl: float) -> list[tuple | None]:
    """For each term that the shard has: bounds and ranges of its blocks, and places, ranges and weights of its documents."""
    out: list[tuple | None] = [None] * len(numbers)
    for term, places, tfs, ends, block_tf, block_dl in s.lists:
        if term in idf:
            weigh = lambda tf, dl, i=idf[term]: i * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            first = places[np.append(0, ends[:-1])]
            out[numbers[term]] = weigh(block_tf, block_dl), first // RANGE, places, places // RANGE, weigh(tfs, s.dl[places])
    return out


def _score(s: _Shard, weighed: list[tuple | None], asked: list[list[int]], top: _Top, read: np.ndarray, total: np.ndarray) -> None:
    """Adds a shard's best documents for each query. Ranges of places go by their blocks' bounds: a sixteenth first, which
    sets a threshold, another one, then those of the rest that can reach it."""
    n_ranges = -(-len(s.ids) // RANGE)
    for q, terms in enumerate(asked):
        lists = [weighed[i] for i in terms if weighed[i] is not None]
        if not lists:
            continue
        bounds, of_block, places, of_place, weights = (np.concatenate(x) for x in zip(*lists, strict=True))
        total[q] += len(bounds)
        upper = np.bincount(of_block, bounds, n_ranges)
        left = np.flatnonzero(upper)
        left = left[np.argsort(-upper[left], kind="stable")]
        first = max(len(left) // 16, top.k // RANGE + 1)
        for step in (first, first, len(left)):
            left = left[upper[left] * 1e6 + 2 >= top.least[q]]
            now, left = left[:step], left[step:]
            if not len(now):
                break
            chosen = np.zeros(n_ranges, bool)
            chosen[now] = True
            read[q] += int(chosen[of_block].sum())
            kept = chosen[of_place]
            scores = np.bincount(places[kept], weights[kept], len(s.ids)) * s.live
            found = np.flatnonzero(scores)
            top.add(q, np.rint(scores[found] * 1e6).astype(np.int64), s.ids[found])


@dataclass(frozen=True)
class Hits:
    """ranking: query_id, doc_id, score, rank; stats: query_id, blocks, blocks_read."""

    ranking: DataFrame
    stats: DataFrame


def search(index: Lexicon, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, stemmed: bool | None = None) -> Hits:
    """The k best documents of each query (query_id, query) by BM25, among the ids of `allowed` (doc_id) if given.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), of the whole live index also under a filter. Scores are rounded to 6 places
    before ties are broken by doc_id; documents without any term of the query are absent. Query ids are distinct."""
    if stemmed is not None and stemmed != index.meta["stemmed"]:
        raise ValueError(f"the index is {'' if index.meta['stemmed'] else 'not '}stemmed")
    asked = materialize(_asked(queries, index.meta["stemmed"]), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    count = max(1, -(-(11 * (size["terms"] or 0)) // (10 * BLOCK_TERMS)))
    parts = [asked] if count == 1 else [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i) for i in range(count)]
    found = reduce(DataFrame.unionByName, [materialize(_searched(index, p, k, allowed), "hits") for p in parts])
    ranking = top_k(found.where("doc_id is not null").select("query_id", "doc_id", "score"), ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
    stats = found.where("doc_id is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("blocks_read").alias("blocks_read"))
    return Hits(ranking, stats)


def _searched(index: Lexicon, asked: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """query_id, doc_id, score of each task's best rows, and rows of what was read; asked is a block of queries."""
    schema = "query_id bigint, doc_id bigint, score double, blocks bigint, blocks_read bigint"
    rows = asked.toArrow()
    ids, of = rows.column("query_id").to_numpy(), rows.column("terms").to_pylist()
    terms = sorted({t for ts in of for t in ts})
    if not terms:
        return index.spark.createDataFrame([], schema)
    n, avgdl = float(index.meta["rows"]), index.meta["tokens"] / max(index.meta["rows"], 1) or 1.0
    idf = {r["term"]: float(np.log(1 + (n - r["n"] + 0.5) / (r["n"] + 0.5))) for r in counts(index, terms).toLocalIterator()}
    number = {t: i for i, t in enumerate(terms)}
    numbers = [[number[t] for t in ts if t in idf] for ts in of]
    filtered, wanted = allowed is not None, pa.array([t for t in terms if t in idf], pa.string())

    def go(batches):
        top, read, total = _Top(len(ids), k), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for s in _shards(batches, filtered, wanted):
            _score(s, _weighed(s, number, idf, avgdl), numbers, top, read, total)
        names = ["query_id", "doc_id", "score", "blocks", "blocks_read"]
        none = lambda n, *kinds: [pa.nulls(n, t) for t in kinds]
        for i, (scores, docs) in zip(ids.tolist(), top.held, strict=True):
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(docs), pa.int64()), pa.array(docs), pa.array(scores / 1e6), *none(len(docs), pa.int64(), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *none(len(ids), pa.int64(), pa.float64()), pa.array(total), pa.array(read)], names=names)

    return _beside(index, allowed).mapInArrow(trimmed(go), schema)
