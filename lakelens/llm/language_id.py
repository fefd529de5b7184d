"""Operator 4, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3, lower case) of the whole text: relative frequency times inverse document
frequency. Document frequencies come from all documents that may be learnt from. Weights are fitted by the
follow-the-regularised-leader method with elastic-net penalties on a bounded sample, `sample_docs` documents dealt
evenly over the languages by a hash of the id; a fifth of that sample fits the temperature of the softmax instead.
The model is one table of 65,537 rows; a text's logits are sums of its rows, so texts stream through in runs of
bounded size, whatever their length.

Only text and lang of documents whose crc32(doc_id) mod 4 is not 2 are learnt from; predictions see the text alone.

Defined results: `und` with score 0 where text is null or has no letter, or nothing could be learnt; null doc_ids are
not held out and not learnt from; of languages of equal odds the first by name wins; repeated rows are predicted each;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Relative frequencies are small; this brings feature vectors near unit length.
SCALE = 20.0
RUN_CHARS = 1 << 19
_LETTER = regex.compile(r"\p{L}")


def held_out(c: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of each order that start at each place; those over a separator (0) go to the last bucket."""
    u = points.astype(np.uint32)
    zero = u == 0
    a = (u + np.uint32(1)) * np.uint32(0x9E3779B1)
    for n in ORDERS:
        h, bad = a[: len(a) - n + 1].copy(), zero[: len(a) - n + 1].copy()
        for j in range(1, n):
            end = len(a) - n + 1 + j
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            h += a[j:end]
            bad |= zero[j:end]
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE3D + 2 * n)
        h = (h >> np.uint32(16)).astype(np.int64)
        h[bad] = BUCKETS
        yield h


def _runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of a run of texts, where each part starts, and its text's index. A text beyond the run's size is
    dealt out in parts, which n-grams don't cross; separators close each part."""
    parts, index, held = [], [], 0
    gap = np.zeros(max(ORDERS) - 1, np.uint32)

    def full():
        points = np.concatenate([x for p in parts for x in (p, gap)])
        sizes = np.array([len(p) + len(gap) for p in parts])
        return points, np.cumsum(sizes) - sizes, np.array(index)

    for i, t in enumerate(texts):
        p = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, max(len(p), 1), RUN_CHARS):
            parts.append(p[at : at + RUN_CHARS])
            index.append(i)
            held += len(parts[-1])
            if held >= RUN_CHARS:
                yield full()
                parts, index, held = [], [], 0
    if parts:
        yield full()


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # float32, BUCKETS + 1 by labels: idf times weight
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        k = len(self.labels)
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
        for points, starts, index in _runs(texts):
            total, n = np.zeros((len(points), k), np.float32), np.zeros(len(points), np.float32)
            for h in _hashes(points):
                total[: len(h)] += self.table[h]
                n[: len(h)] += h < BUCKETS
            np.add.at(sums, index, np.add.reduceat(total, starts, axis=0))
            np.add.at(counts, index, np.add.reduceat(n, starts))
        return self.bias + SCALE * sums / np.maximum(counts, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at) and self.labels:
            p = softmax(self.logits([texts[i] for i in at]) / self.temperature)
            best = p.argmax(axis=1)
            for i, b in zip(at.tolist(), best.tolist(), strict=True):
                labels[i] = self.labels[b]
            scores[at] = p.max(axis=1)
        return labels, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    total = np.zeros(BUCKETS + 1, np.int64)
    for points, _, _ in _runs([text]):
        for h in _hashes(points):
            total += np.bincount(h, minlength=BUCKETS + 1)
    at = np.flatnonzero(total[:BUCKETS])
    return at, total[at]


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents that hold each bucket, over all documents given; each task sends a sparse vector of bounded size."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, bool)
        for b in batches:
            last = -1
            for points, starts, index in _runs(b.column(0).to_pylist()):
                hs = list(_hashes(points))
                edges = [*starts.tolist(), len(points)]
                for i, a, z in zip(index.tolist(), edges, edges[1:], strict=False):
                    if i != last and last >= 0:
                        df += seen
                        seen[:] = False
                    last = i
                    for h in hs:
                        seen[h[a:z]] = True
            df += seen
            seen[:] = False
        at = np.flatnonzero(df[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], schema=schema)

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in docs.select("text").mapInArrow(trimmed(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def _sample(docs: DataFrame, rates: list[tuple[str, float]]) -> list:
    """lang, place in the hash order, buckets and counts of each sampled document; texts stay on the executors."""
    spark = docs.sparkSession
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("langid|"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double")) / float(16**13)
    rate = F.broadcast(spark.createDataFrame(rates, "l string, rate double"))  # a row for each language
    few = docs.join(rate, F.col("lang") == F.col("l")).withColumn("u", u).where("u < rate").select("lang", "u", "text")
    schema = pa.schema([("lang", pa.string()), ("u", pa.float64()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [_counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.string()), b.column("u"), pa.array([x.astype("<i4").tobytes() for x, _ in each], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in each], pa.binary())], schema=schema)

    return few.mapInArrow(trimmed(run), "lang string, u double, at binary, n binary").collect()


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], k: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS by k, sparse in value) and biases; x as places and values."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias, free of penalties

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        if len(at) and at[-1] == BUCKETS:
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha)
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            at, x = np.append(xs[i][0], BUCKETS), np.append(xs[i][1], 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[ys[i]] -= 1
            g = x[:, None] * p
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * w
            n[at] = now
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its log."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(ys)), ys], 1e-12)).mean()
    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, sample_docs: int = 1600, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Learns from all of docs (doc_id, text, lang) that may be learnt from."""
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = sorted((r["lang"], r["n"]) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each language
    if not sizes:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0)
    share = max(1, sample_docs // len(sizes))
    idf = np.log((1 + sum(n for _, n in sizes)) / (1 + document_frequencies(usable))) + 1
    rows = sorted(_sample(usable, [(lang, min(1.0, 1.2 * share / n)) for lang, n in sizes]), key=lambda r: (r["u"], r["lang"]))
    labels, taken, xs, ys = [lang for lang, _ in sizes], {lang: 0 for lang, _ in sizes}, [], []
    for r in rows:
        if taken[r["lang"]] < share:
            taken[r["lang"]] += 1
            at, n = np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i4")
            if len(at):
                xs.append((at, SCALE * n / n.sum() * idf[at]))
                ys.append(labels.index(r["lang"]))
    tune = [i for i in range(len(xs)) if i % 5 == 4]
    learn = [i for i in range(len(xs)) if i % 5 != 4]
    w, bias = ftrl([xs[i] for i in learn], [ys[i] for i in learn], len(labels), epochs, alpha, beta, l1, l2, seed=7)
    logits = np.array([xs[i][1] @ w[xs[i][0]] + bias for i in tune])
    temperature = fit_temperature(logits, np.array([ys[i] for i in tune])) if tune else 1.0
    table = np.zeros((BUCKETS + 1, len(labels)), np.float32)
    table[:BUCKETS] = idf[:, None] * w
    return Model(labels, table, bias, temperature)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep columns (doc_id unless given), lang_pred and score for each row."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows
    cols = [F.col(c) for c in keep] + [F.col("text").cast("string").alias("__text")]
    rows = docs.select(*cols)
    schema = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = shared.value.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(trimmed(run), schema)


def accepted(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a language by the model, at that score or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != "und" and p >= least_score for x, p in zip(labels, scores.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def language_id(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, by a model learnt from the same table."""
    return predict(docs, fit(docs, **params)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
