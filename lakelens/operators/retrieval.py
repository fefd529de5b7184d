"""Lexical and dense retrieval, fusion, reranking, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stems
from ..functions.text import STOP_WORDS, alnum_tokens
from ..storage import exact_unions, materialize
from . import dense as dense_scan
from .idsets import IdSet, members

#: Query sides up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the frame is proven small, else one against it: the planner's estimate of an exploded frame is
    that of its source."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


# ---- lexical index


def index_tokens(c: Column, stemmed: bool = False) -> Column:
    tokens = alnum_tokens(c)
    if not stemmed:
        return tokens
    return stems(F.filter(tokens, lambda w: ~w.isin(STOP_WORDS)))


def postings(docs: DataFrame, doc_id: str, text: Column, stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, tf, dl) and (doc_id, dl) of an inverted index; dl is the document's length in tokens."""
    words = docs.select(F.col(doc_id).alias("doc_id"), index_tokens(text, stemmed).alias("w"))
    lengths = words.select("doc_id", F.size("w").cast("bigint").alias("dl"))
    each = words.select("doc_id", F.size("w").cast("bigint").alias("dl"), F.explode("w").alias("term"))
    return each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "dl"), lengths


def bm25(terms: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None, stemmed: bool = False, stats: tuple[int, float] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query (query_id, query) by BM25.

    Only postings of query terms are read on; statistics are of the whole index, also when `allowed` (doc_id) restricts
    the results. stats: number of documents and their mean length, where they are known. Documents without any query
    term are absent. idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Scores are rounded to 6 places before ties are broken by
    doc_id.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query"), stemmed))).alias("term"))
    if stats is None:
        one = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        stats = (one["n"] or 0, one["avgdl"] or 0.0)
    n, avgdl = float(stats[0]), float(stats[1]) or 1.0
    wanted = terms.join(small(asked.select("term").distinct()), "term", "left_semi")
    df = small(wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    hits = wanted if allowed is None else wanted.join(allowed, "doc_id", "left_semi")
    hits = hits.join(df, "term")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = hits.withColumn("weight", weight).join(small(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank from 1; partitions drop what can't qualify before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


# ---- dense search


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | IdSet | None = None, exclude_self: bool = False, decimals: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank by exact inner product of (vec_id, embedding) with each query (query_id, query).

    The filter, a frame of vec_id or a set of bitmaps, comes before the ranking, so no over-fetching is needed. Large query
    sets are searched in blocks.
    """
    held = vectors
    if isinstance(allowed, IdSet):
        held = members(vectors, "vec_id", allowed)
    elif allowed is not None:
        held = vectors.join(allowed, "vec_id", "left_semi")

    def search(queries: DataFrame) -> DataFrame | None:
        block = dense_scan.block_of(queries)
        return block and dense_scan.top(held, block, k, exclude_self, decimals)

    none = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    return top_k(dense_scan.by_blocks(queries, search, none), ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def first_match_rank(vectors: DataFrame, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
    """query_id, first_rank: the place that the best vector of the query's own label has among all vectors, in the order
    of dense(), for (vec_id, embedding, label) and (query_id, query, query_label). Queries without one are absent.

    Nothing is sorted: one pass finds that vector, the next counts those before it.
    """

    def search(queries: DataFrame) -> DataFrame | None:
        block = dense_scan.block_of(queries, "query_label")
        if block is None:
            return None
        own = dense_scan.best_of_label(vectors, block, exclude_self)
        best = own.groupBy("query_id").agg(F.max_by(F.struct("micro", F.col("vec_id").alias("at")), F.struct("micro", -F.col("vec_id"))).alias("best"))
        block = dense_scan.block_of(queries.join(best, "query_id").select("query_id", "query", "best.*"), "micro", "at")
        if block is None:
            return None
        before = dense_scan.counted_before(vectors, block, exclude_self)
        return before.groupBy("query_id").agg((F.sum("n") + 1).cast("int").alias("first_rank"))

    return dense_scan.by_blocks(queries, search, vectors.sparkSession.createDataFrame([], "query_id bigint, first_rank int"))


def overlap_within(a: DataFrame, b: DataFrame, k: int = 10, tolerance: float = 0.002) -> DataFrame:
    """query_id, common, agree_first of two rankings (query_id, id, score, rank): a result that only b has counts as
    common when its score is within the tolerance of b's last one in the first k."""
    x, y = (r.where(F.col("rank") <= k) for r in (a, b))
    last = y.groupBy("query_id").agg(F.min("score").alias("last"))
    both = y.join(x.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").join(last, "query_id")
    first = x.where("rank = 1").select("query_id", F.col("id").alias("first"))
    return both.join(first, "query_id", "left").groupBy("query_id").agg(
        F.count_if(F.col("hit").isNotNull() | (F.col("score") - F.col("last") <= tolerance)).alias("common"),
        F.bool_or((F.col("rank") == 1) & (F.col("id") == F.col("first"))).alias("agree_first"),
    )


# ---- fusion and reranking


def rrf(lists: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """query_id, id, score, rank: reciprocal rank fusion of rankings (query_id, id, rank). Ties go to what the earlier
    list ranks higher."""
    exact_unions(lists[0].sparkSession)
    tagged = [r.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, r in enumerate(lists)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = [F.col("score").desc(), F.col("seen.list"), F.col("seen.rank"), F.col("id")]
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("seen")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], k: int, depth: int = 50) -> DataFrame:
    """candidates (query_id, id, query, text, rank) in the order of score(query, text), which replaces theirs."""
    scored = candidates.where(F.col("rank") <= depth).withColumn("score", F.round(score(F.col("query"), F.col("text")), 6)).withColumnRenamed("rank", "before")
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("before"), F.col("id")], k)


def word_overlap(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that the text has."""
    q, t = F.array_distinct(alnum_tokens(query)), F.array_distinct(alnum_tokens(text))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def pooled(rankings: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """One row per query and id: its rank in each named ranking, the best rank, the number of rankings, its place."""
    every = None
    for name, r in rankings.items():
        exact_unions(r.sparkSession)
        t = r.select("query_id", key, "rank", F.lit(name).alias("condition"))
        every = t if every is None else every.unionByName(t)
    names = list(rankings)
    wide = every.groupBy("query_id", key).pivot("condition", names).agg(F.min("rank"))
    wide = wide.withColumns({"best_rank": F.array_min(F.array(*names)), "n_conditions": sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))})
    order = [F.col("best_rank"), F.col("n_conditions").desc(), F.col(key)]
    return wide.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def first_per(ranking: DataFrame, key: str) -> DataFrame:
    """A ranking reduced to the first row of each key, ranked anew."""
    best = ranking.groupBy("query_id", key).agg(F.min("rank").alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", key)))


def budget_prefix(df: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each key whose running sum of tokens stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def waterfill(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """key, cap: the largest whole number c with sum(least(size, c)) <= budget; null where no cap is needed.

    Sizes sorted ascending, the cap after i of n is (budget - sum of the first i) / (n - i), valid where it lies between
    the i-th size and the next.
    """
    counted = df.groupBy(key, size).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(key).orderBy(size)
    part = counted.select(
        key,
        F.col(size).alias("size"),
        (F.sum("m").over(w) - F.col("m")).alias("before"),
        (F.sum(F.col(size) * F.col("m")).over(w) - F.col(size) * F.col("m")).alias("sum_before"),
        F.sum("m").over(Window.partitionBy(key)).alias("n"),
        F.sum(F.col(size) * F.col("m")).over(Window.partitionBy(key)).alias("total"),
    )
    cap = F.floor((F.lit(budget) - F.col("sum_before")) / (F.col("n") - F.col("before"))).cast("bigint")
    caps = part.withColumn("c", cap).where((F.col("total") > budget) & (F.col("c") < F.col("size")))
    fits = part.groupBy(key).agg(F.first("total").alias("total"))
    found = caps.groupBy(key).agg(F.min(F.struct("size", "c")).alias("x")).select(F.col(key).alias("__k"), F.greatest(F.col("x.c"), F.lit(0)).alias("cap"))
    return fits.join(found, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, "total", "cap")


# ---- metrics


def ranking_metrics(ranking: DataFrame, gold: DataFrame, ks: list[int], key: str = "id") -> DataFrame:
    """query_id, k, hit, recall, mrr, ndcg for every query with gold (query_id, key); the ranking has distinct keys.

    recall is 0 without results; mrr is of the first gold within k; ndcg is binary, ideal over least(gold, k).
    """
    g = gold.select("query_id", key).distinct()
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    found = g.join(ranking.select("query_id", key, "rank"), ["query_id", key], "left")
    per_k = found.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).withColumn("at", F.when(F.col("rank") <= F.col("k"), F.col("rank")))
    agg = per_k.groupBy("query_id", "k").agg(F.count("at").alias("found"), F.min("at").alias("first"), F.coalesce(F.sum(1 / F.log2(F.col("at") + 1)), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.col("k").cast("bigint")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return agg.join(n, "query_id").select(
        "query_id",
        "k",
        (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.col("found") / F.col("n_gold"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


# ---- registry


def hybrid(lexical: DataFrame, dense_: DataFrame, k: int = 10, candidates: int = 100, rrf_k: int = 60) -> DataFrame:
    """Fusion of the first candidates of both legs."""
    legs = [r.where(F.col("rank") <= candidates) for r in (lexical, dense_)]
    return rrf(legs, rrf_k, k)


RETRIEVERS = ("lexical", "dense", "hybrid", "hybrid_rerank")


def conditions(lexical: DataFrame, dense_: DataFrame, queries: DataFrame, texts: DataFrame, k: int, score: Callable[[Column, Column], Column] = word_overlap, candidates: int = 100, depth: int = 50) -> dict[str, DataFrame]:
    """The four named rankings, (query_id, id, rank) up to k, from one deep list of each leg, which are stored first.
    queries: (query_id, query), texts: (id, text); only texts of candidates are read on."""
    lexical, dense_ = materialize(lexical.select("query_id", "id", "rank"), "leg"), materialize(dense_.select("query_id", "id", "rank"), "leg")
    fused = materialize(hybrid(lexical, dense_, candidates * 2, candidates).select("query_id", "id", "rank"), "fused")
    cut = lambda r: r.where(F.col("rank") <= k)
    return {"lexical": cut(lexical), "dense": cut(dense_), "hybrid": cut(fused), "hybrid_rerank": rerank(candidate_texts(fused, queries, texts, depth), score, k, depth).select("query_id", "id", "rank")}


def candidate_texts(ranking: DataFrame, queries: DataFrame, texts: DataFrame, depth: int = 50) -> DataFrame:
    """query_id, query, id, text, rank of the first candidates of each query."""
    return ranking.where(F.col("rank") <= depth).select("query_id", "id", "rank").join(texts, "id").join(queries, "query_id")
