"""Taxonomy frontiers, journals, usage, splits and the validation of question records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty
from .compare import in_window
from .retrieval import small

UNCLASSIFIED, TOP_ONLY = "(unclassified)", "(top-level only)"

# ---- taxonomy


def bucket(path: Column) -> Column:
    """'first / second' of a slash-separated path."""
    second = F.split_part(path, F.lit("/"), F.lit(2))
    return F.concat(F.split_part(path, F.lit("/"), F.lit(1)), F.lit(" / "), F.when(second == "", TOP_ONLY).otherwise(second))


def frontier(items: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """bucket, n: distinct items of each bucket (paths: key, path), and of none. Buckets overlap by design."""
    inside = paths.select(bucket(F.col("path")).alias("bucket"), key).groupBy("bucket").agg(F.countDistinct(key).alias("n"))
    outside = items.join(paths.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(UNCLASSIFIED).alias("bucket"), "n")
    return inside.unionByName(outside)


def placement(ids: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Ids with the sorted buckets that hold them; unclassified ones too."""
    b = paths.select(key, bucket(F.col("path")).alias("bucket"))
    return ids.join(b, key, "left").groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("bucket", F.lit(UNCLASSIFIED)))).alias("buckets"))


def statuses(buckets: DataFrame, mined: DataFrame, mapped: DataFrame) -> DataFrame:
    """Buckets with status: mined, else mapped, else unexplored. mined and mapped: frames of bucket."""
    m, p = mined.select("bucket").distinct().withColumn("m", F.lit(1)), mapped.select("bucket").distinct().withColumn("p", F.lit(1))
    status = F.when(F.col("m") == 1, "mined").when(F.col("p") == 1, "mapped").otherwise("unexplored")
    return buckets.join(m, "bucket", "left").join(p, "bucket", "left").withColumn("status", status).drop("m", "p")


def orientation_blocks(paths: DataFrame, key: str, items: DataFrame, scheme: str, told: DataFrame, told_key: str) -> DataFrame:
    """block, key, n: items of each first branch of a taxonomy (paths: key, path), items of each scheme, those without one
    by themselves, and how many have a text."""
    branches = paths.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("key")).agg(F.countDistinct(key).alias("n")).select(F.lit("branch").alias("block"), "key", "n")
    by = items.groupBy(F.col(scheme).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    schemes = by.where("key is not null").select(F.lit("scheme").alias("block"), "key", "n")
    none = items.agg(F.count_if(F.col(scheme).isNull()).alias("n")).select(F.lit("no scheme").alias("block"), F.lit("").alias("key"), "n")
    text = told.agg(F.countDistinct(told_key).alias("n")).select(F.lit("with text").alias("block"), F.lit("").alias("key"), "n")
    return branches.unionByName(schemes).unionByName(none).unionByName(text)


def slices(buckets: DataFrame, size: int = 3) -> DataFrame:
    """Buckets, largest first, in slices of so many. The taxonomy's top levels are few by nature: one task orders them."""
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "bucket"))
    return buckets.withColumn("slice", F.floor((place - 1) / size).cast("int") + 1)


# ---- journals


def collapse(journal: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last line of each key by aggregation: no sort of whole groups; first_seen keeps the order of appearance."""
    rest = [c for c in journal.columns if c not in keys]
    return journal.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"), F.min(order).alias("first_seen")).select(*keys, "last.*", "first_seen")


def overlaps(cohorts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, cohorts: ids that several of the named cohorts hold; none if they are disjoint."""
    every = None
    for name, df in cohorts.items():
        part = df.select(key, F.lit(name).alias("cohort")).distinct()
        every = part if every is None else every.unionByName(part)
    held = every.groupBy(key).agg(F.array_sort(F.collect_set("cohort")).alias("cohorts"))
    return held.where(F.size("cohorts") > 1)


def taken(cohorts: list[DataFrame], key: str) -> DataFrame:
    """The distinct ids that any cohort holds."""
    out = cohorts[0].select(key)
    for c in cohorts[1:]:
        out = out.unionByName(c.select(key))
    return out.distinct()


def pending(planned: DataFrame, journal: DataFrame, keys: list[str]) -> DataFrame:
    """Planned pairs that a resumed run still has to do."""
    return planned.join(journal.select(*keys).distinct(), keys, "left_anti")


def merged_slots(journal: DataFrame, key: str, order: str) -> DataFrame:
    """Per slot: last status, highest candidate index, rounds, distinct findings (class, severity, claim)."""
    finding = F.concat_ws("|", "class", "severity", "claim")
    return journal.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max("candidate_index").alias("candidate_index"), F.countDistinct("round").alias("rounds"), F.countDistinct(F.when(F.col("claim").isNotNull(), finding)).alias("findings"))


def folded_slots(lines: DataFrame, key: str, order: str) -> DataFrame:
    """key, decisions, findings of lines with judge_decisions (round, disposition, targets, rationale) and findings (class,
    severity, claim, further fields). A line whose rounds and dispositions go on from all before replaces them, else its
    unseen decisions are appended; a finding said again takes the place of the first, with its last wording."""
    each = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("judge_decisions").alias("d"), F.col("findings").alias("f")))).alias("l"))
    begun = lambda d: F.transform(d, lambda x: F.struct(x["round"].alias("a"), x["disposition"].alias("b")))
    said = lambda x: F.struct(x["round"].alias("a"), x["disposition"].alias("b"), x["targets"].alias("c"), F.coalesce(x["rationale"], F.lit("")).alias("d"))
    about = lambda x: F.struct(x["class"].alias("a"), x["severity"].alias("b"), F.coalesce(x["claim"], F.lit("")).alias("c"))
    listed = lambda name: F.filter(F.transform("l", lambda x: x[name]), lambda x: F.coalesce(F.size(x) > 0, F.lit(False)))

    def judged(acc: Column, line: Column) -> Column:
        unseen = F.filter(line, lambda d: ~F.exists(acc, lambda x: said(x).eqNullSafe(said(d))))
        return F.when(F.slice(begun(line), F.lit(1), F.size(acc)).eqNullSafe(begun(acc)), line).otherwise(F.concat(acc, unseen))

    def found(acc: Column, f: Column) -> Column:
        same = lambda x: about(x).eqNullSafe(about(f))
        return F.when(F.exists(acc, same), F.transform(acc, lambda x: F.when(same(x), f).otherwise(x))).otherwise(F.concat(acc, F.array(f)))

    none = lambda name: F.slice(F.flatten(listed(name)), 1, 0)
    return each.select(key, F.aggregate(listed("d"), none("d"), judged).alias("decisions"), F.aggregate(F.flatten(listed("f")), none("f"), found).alias("findings"))


def _tally(metric: str, df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "key", "n")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def journal_summary(slots: DataFrame) -> DataFrame:
    """metric, key, n over merged slots (status, candidate_index, judge_decisions, findings with class, severity, ruling):
    final status, candidates tried, rounds of adjudication, dispositions, severities, classes (those of one's own making
    as one), rulings of HIGH and MID findings, and accepted slots with an upheld finding or a fix."""
    decisions = slots.select("status", F.explode("judge_decisions").alias("d"))
    found = slots.select("status", F.explode("findings").alias("f")).select("status", "f.*")
    upheld = F.upper(or_empty(F.col("ruling"))).startswith("UPHELD")
    bucket = F.when(upheld, "UPHELD").when(F.col("ruling").isin("DISMISSED", "RECORDED"), F.col("ruling")).otherwise("unadjudicated")
    serious = found.where(F.col("severity").isin("HIGH", "MID"))
    rounds = F.coalesce(F.greatest(F.size("judge_decisions"), F.lit(0)), F.lit(0))
    accepted = slots.where("status = 'ACCEPTED'")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "n")
    said = lambda c, test: F.coalesce(F.exists(c, test), F.lit(False))
    tried = slots.agg(F.coalesce(F.sum(F.coalesce("candidate_index", F.lit(0)) + 1), F.lit(0)).cast("bigint").alias("n"))
    return _stacked([
        _tally("status", slots, F.col("status")),
        tried.select(F.lit("candidates tried").alias("metric"), F.lit("").alias("key"), "n"),
        _tally("rounds", slots, rounds),
        _tally("disposition", decisions, F.col("d.disposition")),
        _tally("severity", found, F.col("severity")),
        _tally("class", found, F.when(F.col("class").startswith("OTHER:"), "OTHER:*").otherwise(F.coalesce("class", F.lit("?")))),
        _tally("ruling", serious, F.concat("severity", F.lit("/"), bucket)),
        one("accepted with an upheld finding", accepted.where(said("findings", lambda f: f["severity"].isin("HIGH", "MID") & F.upper(or_empty(f["ruling"])).startswith("UPHELD")))),
        one("accepted with a fix", accepted.where(said("judge_decisions", lambda d: d["disposition"] == "FIX"))),
    ])


def call_summary(calls: DataFrame) -> DataFrame:
    """metric, key, n over logged calls (tool, ok, failures, ts): calls by tool, errors, calls with failures, active days."""
    one = lambda name, c: calls.agg(c.cast("bigint").alias("n")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "n")
    return _stacked([
        _tally("tool", calls, F.col("tool")),
        _tally("with failures", calls.where("failures > 0"), F.col("tool")),
        one("errors", F.count_if(F.col("ok") == F.lit(False))),
        one("active days", F.countDistinct(F.to_date("ts"))),
    ])


def bank_summary(bank: DataFrame, trimmed: DataFrame, accepted: DataFrame, key: str = "question_id") -> DataFrame:
    """metric, n: ids in the bank, trimmed from it, in either, and how many of each came from batches."""
    tag = lambda df, name: df.select(key, F.lit(name).alias("of"))
    held = _stacked([tag(bank, "bank"), tag(trimmed, "trimmed"), tag(accepted, "accepted")]).groupBy(key).agg(F.collect_set("of").alias("of"))
    has = lambda x: F.array_contains("of", x)
    tests = {"bank": has("bank"), "trimmed": has("trimmed"), "either": has("bank") | has("trimmed"), "bank from batches": has("bank") & has("accepted"), "bank otherwise": has("bank") & ~has("accepted"), "trimmed from batches": has("trimmed") & has("accepted")}
    one = held.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(tests.values())])
    rows = [F.struct(F.lit(n).alias("metric"), F.col(f"c{i}").alias("n")) for i, n in enumerate(tests)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def steps(events: DataFrame, key: str, at: str, opens: Column, ends: Column, then: str | None = None) -> DataFrame:
    """key, n_steps, active, span in seconds. An event that opens starts a step; a step ends at its last event that ends
    one; what lies between steps is nobody's. Work before the first opener is a step of its own. then: orders events of
    one moment."""
    w = Window.partitionBy(key).orderBy(*[at, then][: 1 + (then is not None)]).rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("step", F.sum(opens.cast("int")).over(w)).withColumn("__e", ends)
    per = numbered.groupBy(key, "step").agg(F.min(at).alias("a"), F.max(F.when(F.col("__e"), F.col(at))).alias("z"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    seconds = F.greatest(F.coalesce(F.unix_micros("z") - F.unix_micros("a"), F.lit(0)), F.lit(0)) / 1e6
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.sum(seconds), 3).alias("active"), F.round((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 1e6, 3).alias("span"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with cost: the first price (lowest place) whose name the model contains, per million tokens; cache reads
    cost a tenth of input, cache writes a quarter more. prices: place, name, input, output; broadcast if it is short."""
    models = usage.select("model").distinct()
    hit = models.join(small(prices), F.contains(F.lower("model"), F.lower("name"))).groupBy("model").agg(F.min_by(F.struct("input", "output"), "place").alias("p"))
    cost = ((F.col("fresh") + 0.1 * F.col("cache_read") + 1.25 * F.col("cache_write")) * F.col("p.input") + F.col("out") * F.col("p.output")) / 1e6
    return usage.join(hit, "model", "left").withColumn("cost", F.round(cost, 9)).drop("p")


def merged_maps(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sums of a map column by key and map key, back as one map."""
    each = df.select(key, F.explode(column).alias("__k", "__v")).groupBy(key, "__k").agg(F.sum("__v").alias("__v"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(column))


def rolled_up(usage: DataFrame, key: str, model: str, tokens: str) -> DataFrame:
    """key, models (sorted), tokens by model as a map, and their sum: one shuffle of sums by model."""
    each = usage.groupBy(key, model).agg(F.sum(tokens).alias("__v"))
    return each.groupBy(key).agg(
        F.array_sort(F.collect_list(model)).alias("models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(model), F.col("__v"))))).alias("by_model"),
        F.sum("__v").alias("total"),
    )


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, upper_median: the value at place n // 2 (from 0) of each group's known values in order. Equal values are
    counted first, and running counts find the place, so that no group is gathered as a list."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*keys).orderBy(value))
    n = F.sum("__m").over(Window.partitionBy(*keys))
    return counted.withColumns({"__upto": upto, "__n": n}).where(F.col("__upto") > F.floor(F.col("__n") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"))


def cell(value: Column, median: bool = True) -> list[Column]:
    """Count, mean, minimum, median and maximum of the known values. The median gathers a group's distinct values in one
    task; for large groups leave it out and take it from quantiles()."""
    middle = [F.round(F.median(value), 6).alias("median")] if median else []
    return [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), *middle, F.max(value).alias("most")]


def pass_share(passed: Column) -> list[Column]:
    """Share that passed of what was scored, and how many were not."""
    return [F.round(F.count_if(passed) / F.nullif(F.count(passed), F.lit(0)), 6).alias("pass_share"), F.count_if(passed.isNull()).alias("unscored")]


# ---- splits and picks


def arithmetic_hash(c: Column, seed: int) -> Column:
    """A portable pseudo-random number of an id."""
    return F.pmod(F.pmod(c, F.lit(2147483647)) * F.lit(48271) + F.lit(seed * 69621), F.lit(2147483647))


def stratified_split(df: DataFrame, key: str, strata: list[str], seed: int = 1, parent: str | None = None) -> DataFrame:
    """Rows with part: of each stratum round(2n / 3) by hash order go to dev, the rest is held out; rows with a parent
    follow it. Strata are counted first, so each part is found by its rank."""
    roots = df if parent is None else df.where(F.col(parent).isNull())
    w = Window.partitionBy(*strata)
    ranked = roots.withColumns({"__r": F.row_number().over(w.orderBy(arithmetic_hash(F.col(key), seed), key)), "__n": F.count(F.lit(1)).over(w)})
    parts = ranked.withColumn("part", F.when(F.col("__r") <= F.floor((2 * F.col("__n") * 2 + 3) / 6), "dev").otherwise("heldout")).drop("__r", "__n")
    if parent is None:
        return parts
    of = parts.select(F.col(key).alias("__p"), F.col("part"))
    return parts.unionByName(df.where(F.col(parent).isNotNull()).join(of, F.col(parent) == F.col("__p")).drop("__p"))


def balanced_pick(rows: list[dict], n: int, keys: tuple[str, ...]) -> list[dict]:
    """Picks one after another what is least used so far by each key in turn, then the smallest id. Sequential by
    nature, over a bank's few hundred rows on the driver."""
    used: dict[tuple, int] = {}
    left, out = list(rows), []
    while left and len(out) < n:
        best = min(left, key=lambda r: (*[used.get((k, r[k]), 0) for k in keys], r["id"]))
        left.remove(best)
        out.append(best)
        for k in keys:
            used[k, best[k]] = used.get((k, best[k]), 0) + 1
    return out


def next_ids(df: DataFrame, prefix: Column, number: Column, wanted: int) -> DataFrame:
    """prefix, id: the next free numbers of each prefix."""
    top = df.groupBy(prefix.alias("prefix")).agg(F.max(number).alias("top"))
    return top.select("prefix", F.explode(F.sequence(F.col("top") + 1, F.col("top") + wanted)).alias("id"))


def gaps(filled: DataFrame, staged: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with what is filled, staged and still missing of each cell."""
    tally = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = targets.join(tally(filled, "filled"), keys, "left").join(tally(staged, "staged"), keys, "left").fillna(0, ["filled", "staged"])
    return out.withColumn("missing", F.greatest(F.col("target") - F.col("filled") - F.col("staged"), F.lit(0)))


# ---- question records

# The closed vocabularies of a record.
ROUTES = ["sql", "vector", "hybrid", "adversarial", "ambiguous"]
LEVELS = ["L1", "L2", "L3"]
GOLD_BOUNDS = {"filter-read": (1, 1), "filter-synthesize": (2, 4), "filter-compare": (2, 4), "filter-survey": (5, None)}


def violations(bank: DataFrame) -> DataFrame:
    """question_id, violation: one row for each broken rule of a record or between records."""
    size = F.coalesce(F.size("gold_project_ids"), F.lit(0))
    topical = F.col("expected_route").isin("vector", "hybrid")
    has = lambda c: F.lit(c in bank.columns)
    answer = F.col("answer_columns") if "answer_columns" in bank.columns else F.lit(None).cast("array<string>")
    review = F.trim(or_empty(F.col("override_reason"))) if "override_reason" in bank.columns else F.lit("")
    level = F.when(size == 1, "L1").when(size.between(2, 4), "L2").when(size >= 5, "L3")
    survivors = F.coalesce(F.size("filter_evidence.survivor_ids"), F.lit(0))
    fits = in_window(F.col("subtype"), survivors)
    bounds = F.lit(False)
    for name, (low, high) in GOLD_BOUNDS.items():
        bounds = bounds | ((F.col("subtype") == name) & ((size < low) | ((size > high) if high else F.lit(False))))
    rules = {
        "no text": F.trim(or_empty(F.col("text"))) == "",
        "unknown route": ~F.coalesce(F.col("expected_route").isin(*ROUTES), F.lit(False)),
        "unknown level": ~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)),
        "no gold sql": (F.col("expected_route") == "sql") & (F.trim(or_empty(F.col("gold_sql"))) == ""),
        "no gold ids": topical & (size == 0),
        "repeated gold ids": size > F.coalesce(F.size(F.array_distinct("gold_project_ids")), F.lit(0)),
        "gold count outside the subtype": (F.col("expected_route") == "hybrid") & bounds,
        "gold outside the survivors": F.coalesce(F.size(F.array_except("gold_project_ids", F.col("filter_evidence.survivor_ids"))) > 0, F.lit(False)),
        "hybrid without filter evidence": (F.col("expected_route") == "hybrid") & F.col("filter_evidence").isNull(),
        "filter evidence on another route": F.col("filter_evidence").isNotNull() & ~F.coalesce(F.col("expected_route").isin("hybrid", "adversarial"), F.lit(False)),
        "repeated survivors": survivors > F.coalesce(F.size(F.array_distinct("filter_evidence.survivor_ids")), F.lit(0)),
        "survivors outside the subtype's window": (F.col("expected_route") == "hybrid") & F.col("filter_evidence").isNotNull() & ~F.coalesce(fits, F.lit(True)) & (review == ""),
        "level unlike the gold count": (F.col("expected_route") == "vector") & (size > 0) & ~F.col("level").eqNullSafe(level) & (review == ""),
        "unknown subtype": (F.col("expected_route") == "hybrid") & F.col("subtype").isNotNull() & ~F.coalesce(F.col("subtype").isin(*GOLD_BOUNDS), F.lit(False)),
        "adversarial with gold": (F.col("expected_route") == "adversarial") & ((size > 0) | (F.trim(or_empty(F.col("gold_sql"))) != "")),
        "answer columns without gold sql": has("answer_columns") & (F.coalesce(F.size(answer), F.lit(0)) > 0) & (F.trim(or_empty(F.col("gold_sql"))) == ""),
        "repeated answer columns": has("answer_columns") & (F.coalesce(F.size(answer), F.lit(0)) > F.coalesce(F.size(F.array_distinct(F.transform(answer, lambda c: F.lower(c)))), F.lit(0))),
        "bad id": ~F.coalesce(F.col("question_id").rlike("^[a-z][a-z0-9-]*$"), F.lit(False)),
        "no absence proof": (F.col("expected_route") == "adversarial") & (F.coalesce(F.size("absence_evidence"), F.lit(0)) == 0),
    }
    own = bank.select("question_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("violation"))
    again = bank.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("question_id", F.lit("repeated id").alias("violation"))
    texts = bank.groupBy(F.lower(F.trim("text")).alias("t")).agg(F.countDistinct("question_id").alias("n"), F.array_sort(F.collect_set("question_id")).alias("ids")).where("n > 1")
    same = texts.select(F.explode("ids").alias("question_id"), F.lit("repeated text").alias("violation"))
    twins = bank.where("twin_id is not null").select("question_id", "twin_id", "expected_route")
    of = bank.select(F.col("question_id").alias("t"), F.col("expected_route").alias("twin_route")).distinct()
    problem = F.when(F.col("t").isNull(), "unknown twin").when(F.col("question_id") == F.col("twin_id"), "its own twin").when(F.col("twin_route") == "adversarial", "twin is adversarial")
    paired = twins.join(of, F.col("twin_id") == F.col("t"), "left").select("question_id", problem.alias("violation")).where("violation is not null")
    return own.unionByName(again).unionByName(same).unionByName(paired)
