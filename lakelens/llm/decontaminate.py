"""Operator 6, benchmark decontamination by SimHash windows.

Native: DataFrame expressions only. Words are runs of letters and digits in lower case; shingles are runs of five.

1. Windows. Items of one number c of shingles are searched in windows of c shingles. Every place of every document is a
   window's start, but those are left out of which fewer than threshold x c shingles belong to any item of that length:
   they can't reach the threshold with one. A window that starts with a foreign shingle, or ends with one at the text's
   end, only gains by moving on; so windows start at shingles of items, or, cut short by the text's begin, end there.
2. SimHash: 64 bits, each the majority over the window's shingles with their multiplicities, for windows and items.
3. Multi-index. Fingerprints are cut into BLOCKS blocks. Two that differ in at most `radius` bits differ in at most
   radius / BLOCKS bits of some block; items stand under all values that near their own, windows look up their own.
   An equality join over (length, block, value) so finds all items within the radius of each window.
   At similarity 0.8 of two sets of equal size bits differ with probability 0.15, 9.7 of 64 on average, and more than
   the radius of 19 with probability 0.0007. Where a shingle repeats, in the item or the window, or where a text's edge
   makes the window shorter, more bits may differ: such windows meet items by a shingle in common instead.
4. Exact similarity: shingles weighted by their multiplicity, sum of minima over sum of maxima.

Items of fewer words than a shingle are one shingle, and match whole documents of the same words only.

Defined results: null or empty texts and items match nothing; rows that share a doc_id (null too) are one document, of
which any row may match; repeated items match each by its item_id; of windows of equal similarity the first counts;
texts of any length are searched whole; empty tables, of documents or items, give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Tables of the benchmark up to these numbers of rows are broadcast, its shingles (16 bytes each) and others; longer ones
#: are joined by shuffling.
BROADCAST_SHINGLES, BROADCAST_ROWS = 1_000_000, 100_000
BITS, BLOCKS = 64, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: Column, size: int) -> Column:
    """Hashes of the runs of `size` words; of fewer words, one of all; of none, nothing. Missing words add nothing to a hash."""
    run = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
    return F.when(F.size(w) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), run))


def _hashed(df: DataFrame, key: str, size: int) -> DataFrame:
    return df.select(F.col(key), words(text_of()).alias("w")).select(key, shingle_hashes(F.col("w"), size).alias("hashes"))


def simhash(exploded: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """keys and fp: majorities over rows of shingles. Each sum counts two bits, in the halves of a long."""
    lanes = [F.sum(F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit((1 << 32) | 1))).alias(f"s{i}") for i in range(32)]
    counted = exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes)
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    bits = []
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"s{i}"), 32)
        bits.append(F.when(low * 2 > F.col("n"), F.shiftleft(one, i)).otherwise(zero))
        bits.append(F.when(high * 2 > F.col("n"), F.shiftleft(one, i + 32)).otherwise(zero))
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _cuts() -> list[tuple[int, int]]:
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(edges, edges[1:], strict=False))


def blocks(fp: Column) -> Column:
    """(number, value) of each block of neighbouring bits."""
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(_cuts())])


def near_blocks(fp: Column, radius: int) -> Column:
    """(number, value) of all values that differ from a block in at most radius / BLOCKS bits."""

    def near(i: int, a: int, b: int) -> Column:
        masks = [sum(1 << x for x in bits) for k in range(radius // BLOCKS + 1) for bits in combinations(range(b - a), k)]
        own = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.struct(F.lit(i).alias("no"), own.bitwiseXOR(m).alias("value")))

    return F.concat(*[near(i, a, b) for i, (a, b) in enumerate(_cuts())])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two lists of shingles, each weighted by how often it occurs."""
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def _bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of the benchmark, broadcast after a count shows that it is short. A longer one is merged: the planner knows
    the size of what it is exploded from, not its own."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def places_of_item_shingles(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """doc_id, c, places: where a document holds shingles of items that have c of them, in order."""
    shingles = items.select("c", F.explode("item").alias("h")).distinct()
    # An outer explode: for an inner one the optimizer would infer a filter and evaluate the hashes twice below it.
    held = _hashed(docs, "doc_id", size).select("doc_id", F.posexplode_outer("hashes").alias("pos", "h")).join(_bounded(shingles, BROADCAST_SHINGLES), "h")
    return held.groupBy("doc_id", "c").agg(F.array_sort(F.collect_set("pos")).alias("places"))


def _spans(c: Column, places: Column, threshold: float) -> Column:
    """(start, end) of the windows of c shingles that hold enough of these places."""
    need = F.ceil(F.lit(threshold) * c - F.lit(1e-9)).cast("int")
    span = lambda a, z: F.struct(a.cast("int").alias("start"), z.cast("int").alias("end"))
    full = F.transform(places, lambda p, i: F.when(F.get(places, i + need - 1) < p + c, span(p, p + c)))
    cut = F.transform(places, lambda p, i: F.when((i + 1 >= need) & (p + 1 < c), span(F.lit(0), p + 1)))
    return F.filter(F.concat(full, cut), lambda x: x.isNotNull())


def windows(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    """uid, doc_id, c, start and shingles of every window that could reach the threshold."""
    spans = places_of_item_shingles(docs, items, size).select("doc_id", "c", _spans(F.col("c"), F.col("places"), threshold).alias("spans")).where(F.size("spans") > 0)
    wanted = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("c", "spans")).alias("wanted")), "windows")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    held = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "wanted", words(text_of()).alias("w"))
    held = held.select("doc_id", "wanted", shingle_hashes(F.col("w"), size).alias("hashes"))
    by_length = held.select("doc_id", "hashes", F.explode("wanted").alias("x")).select("doc_id", "hashes", "x.c", "x.spans")
    cut = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.slice("hashes", s["start"] + 1, s["end"] - s["start"]).alias("window")))
    found = by_length.select("doc_id", "c", F.explode(cut).alias("x")).select("doc_id", "c", "x.start", "x.window").where(F.size("window") > 0)
    return materialize(found.withColumn("uid", F.monotonically_increasing_id()), "window-shingles")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 19) -> DataFrame:
    """doc_id, item_id, similarity, start (shingle of the document) and hamming of the best window of each matching pair."""
    hashed = _hashed(benchmark, "item_id", size).where(F.size("hashes") > 0).select("item_id", F.col("hashes").alias("item"), F.size("hashes").alias("c"))
    repeats = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    # Items that share an item_id are told apart by a number of their own.
    items = materialize(hashed.withColumns({"odd": repeats(F.col("item")), "iid": F.monotonically_increasing_id()}), "items")
    seen = windows(docs, items, size, threshold).withColumn("odd", repeats(F.col("window")) | (F.size("window") < F.col("c")))

    prints = simhash(seen.select("uid", "c", F.explode("window").alias("h")), ["uid", "c"])
    item_prints = simhash(items.select("iid", "c", F.explode("item").alias("h")), ["iid", "c"])
    index = item_prints.select("iid", F.col("fp").alias("item_fp"), "c", F.explode(near_blocks(F.col("fp"), radius)).alias("b")).select("iid", "item_fp", "c", "b.no", "b.value")
    looked_up = prints.select("uid", "fp", "c", F.explode(blocks(F.col("fp"))).alias("b")).select("uid", "fp", "c", "b.no", "b.value")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = looked_up.join(_bounded(index), ["c", "no", "value"]).where(differ <= radius).select("uid", "iid")

    item_shingles = items.select("iid", "c", "odd", F.explode("item").alias("h"))
    meet = lambda some, of: some.select("uid", "c", F.explode("window").alias("h")).join(_bounded(of), ["c", "h"]).select("uid", "iid")
    odd = meet(seen.where("odd"), item_shingles.drop("odd")).unionByName(meet(seen.where("not odd"), item_shingles.where("odd").drop("odd")))

    pairs = near.unionByName(odd).distinct()
    checked = (
        pairs.join(seen.select("uid", "doc_id", "start", "window"), "uid")
        .join(_bounded(items.select("iid", "item_id", "item")), "iid")
        .withColumn("similarity", weighted_jaccard(F.col("window"), F.col("item")))
        .where(F.col("similarity") >= threshold)
    )
    checked = checked.join(prints.select("uid", "fp"), "uid").join(_bounded(item_prints.select("iid", F.col("fp").alias("item_fp"))), "iid").withColumn("hamming", differ)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("hamming")).alias("near"))).alias("best")
    return (
        checked.groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), (-F.col("best.near")).alias("hamming"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark, **params).select(F.col("doc_id").alias("bad")).distinct()
    # The row itself travels as a struct, whatever its columns are called.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
