"""Cutting texts into chunks under a token budget."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, paragraphs, raw_sentences
from ..llm.common import small_batches, trimmed

# The chunk policy.
TARGET, CAP, OVERLAP, SAFETY, LEAST_BUDGET = 400, 512, 50, 8, 32
#: Texts that a task cuts at once.
CUT_ROWS = 100
_SENTENCE = re.compile(r"(?<=[.!?])\s|(?<=[.!?][\"')\]])\s")
_WORD = re.compile(r"\S+\s*")


def whitespace_tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of each word; the stand-in for a model's tokenizer."""
    return [(m.start(), m.start() + len(m.group().rstrip())) for m in _WORD.finditer(text)]


def greedy_groups(c: Column, target: int) -> Column:
    """Paragraphs packed in order: (text, n_tokens) of each chunk. A chunk closes before the paragraph that would take it
    past the target; tokens are words. A fold over the paragraphs, inside the JVM."""
    parts = F.transform(paragraphs(c), lambda p: F.struct(p.alias("text"), F.size(F.split(p, r"\s+")).alias("n")))
    empty = F.expr("cast(array() as array<struct<text:string,n_tokens:int>>)")
    start = F.struct(empty.alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + p["n"] > target)
        closed = F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n_tokens"))))
        joined = F.when(acc["n"] == 0, p["text"]).otherwise(F.concat(acc["text"], F.lit("\n"), p["text"]))
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
            F.when(full, p["text"]).otherwise(joined).alias("text"),
            F.when(full, p["n"]).otherwise(acc["n"] + p["n"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["n"].alias("n_tokens")))))

    return F.aggregate(parts, start, step, finish)


def runs(sizes: list[int], limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Ranges of parts, each as long as it fits the limit, found on running sums. A range begins anew with the last parts
    of the one before that come to no more than the overlap, never with all of them, and only if the next part fits
    beside them."""
    total = [0, *accumulate(sizes)]
    out, first, end = [], 0, 0
    while end < len(sizes):
        end = max(bisect_right(total, total[first] + limit) - 1, end + 1)
        out.append((first, end))
        if end < len(sizes):
            back = max(bisect_left(total, total[end] - overlap), first + 1)
            first = back if total[end + 1] - total[back] <= limit else end
    return out


class Chunker:
    """Cuts one section: whole paragraphs up to the target, longer ones by sentences with an overlap, and sentences
    beyond the budget by windows of tokens. No chunk with its header passes the cap."""

    def __init__(self, tokenize: Callable[[str], list[tuple[int, int]]] = whitespace_tokens, target: int = TARGET, cap: int = CAP, overlap: int = OVERLAP, special: int = 2):
        self.tokenize, self.target, self.cap, self.overlap, self.special = tokenize, target, cap, overlap, special

    def n(self, text: str) -> int:
        return len(self.tokenize(text))

    def parts(self, paragraph: str, budget: int) -> list[str]:
        """A long paragraph's sentences, those beyond the budget in windows that overlap."""
        out, begin = [], 0
        for end in [*(m.end() for m in _SENTENCE.finditer(paragraph)), len(paragraph)]:
            sentence, begin = paragraph[begin:end], end
            spans = self.tokenize(sentence)
            if len(spans) <= budget:
                out += [sentence] if sentence.strip() else []
                continue
            step = max(budget - self.overlap, 1)
            last = max(len(spans) - budget, 0)
            places = [*range(0, last, step), -(-last // step) * step]
            out += [sentence[spans[a][0] : spans[min(a + budget, len(spans)) - 1][1]] for a in places]
        return out

    def chunks(self, text: str | None, header: str, whole: bool = False) -> list[str]:
        """Texts without their header. whole: fill up to the cap, not to the target."""
        budget = self.cap - self.n(header) - self.special - SAFETY
        if budget < LEAST_BUDGET:
            raise ValueError(f"the header leaves {budget} tokens")
        target = min(self.cap if whole else self.target, budget)
        sized = [(p, self.n(p)) for p in (x.strip() for x in (text or "").split("\n")) if p]
        out = []
        for long, some in groupby(sized, key=lambda x: x[1] > budget):
            some = list(some)
            if long:
                for p, _ in some:
                    parts = self.parts(p, budget)
                    out += ["".join(parts[a:z]).strip() for a, z in runs([self.n(x) for x in parts], budget, self.overlap)]
            else:
                out += ["\n".join(p for p, _ in some[a:z]) for a, z in runs([n for _, n in some], target)]
        for x in out:
            if self.n(f"{header}\n{x}") + self.special > self.cap:
                raise AssertionError("a chunk passes the cap")
        return out


def chunk_table(sections: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """chunk_id, project_id, source, section, n_tokens, text from (project_id, header, source, section, text); Arrow
    batches of lists in and out."""
    c = chunker or Chunker()
    schema = pa.schema([("chunk_id", pa.string()), ("project_id", pa.int64()), ("source", pa.string()), ("section", pa.string()), ("n_tokens", pa.int32()), ("text", pa.string())])

    def run(batches):
        for b in (x.slice(i, CUT_ROWS) for x in batches for i in range(0, len(x), CUT_ROWS)):
            ids, headers, sources, names, texts = (b.column(i).to_pylist() for i in range(5))
            cut = [c.chunks(text, f"{header} | {name}", whole=source == "objective") for header, source, name, text in zip(headers, sources, names, texts, strict=True)]
            at = [i for i, chunks in enumerate(cut) for _ in chunks]
            flat = [x for chunks in cut for x in chunks]
            keys = [f"{ids[i]}:{sources[i]}:{names[i]}:{n:03d}" for i, chunks in enumerate(cut) for n in range(len(chunks))]
            cols = [keys, [ids[i] for i in at], [sources[i] for i in at], [names[i] for i in at], [c.n(x) for x in flat], flat]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema, strict=True)], schema=schema)

    small_batches(sections.sparkSession)
    return sections.select(F.col("project_id").cast("bigint"), "header", "source", "section", "text").mapInArrow(trimmed(run), "chunk_id string, project_id bigint, source string, section string, n_tokens int, text string")


def report_sections(projects: DataFrame, reports: DataFrame) -> DataFrame:
    """project_id, header, source, section, text of what is cut: each project's objective, and the named sections of its
    reports. projects: id, acronym, title, objective; reports: project_id, and a column for each section."""
    from ..functions.text import header

    own = projects.select(F.col("id").alias("project_id"), header(F.col("acronym"), F.col("title"), F.lit("objective")).alias("header"), F.lit("objective").alias("source"), F.lit("objective").alias("section"), F.col("objective").alias("text"))
    names = [c for c in reports.columns if c != "project_id"]
    each = reports.select("project_id", F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("text")) for n in names])).alias("x")).select("project_id", "x.section", "x.text")
    heads = projects.select(F.col("id").alias("project_id"), "acronym", "title")
    told = each.join(heads, "project_id").select("project_id", header(F.col("acronym"), F.col("title"), F.col("section")).alias("header"), F.lit("report").alias("source"), "section", "text")
    return own.unionByName(told).where(F.trim(or_empty(F.col("text"))) != "")


def structure_first(c: Column, target: int = TARGET * 4, cap: int = CAP * 4) -> Column:
    """Texts of chunks by characters: paragraphs packed, with line breaks, up to the target; one beyond the cap stands
    apart, as its sentences packed without a break up to the cap. A fold over the paragraphs, inside the JVM."""
    flat = F.transform(
        paragraphs(c),
        lambda p: F.when(F.length(p) > cap, F.transform(raw_sentences(p), lambda s, i: F.struct(s.alias("text"), F.lit(cap).alias("most"), F.lit("").alias("glue"), (i == 0).alias("opens")))).otherwise(
            F.array(F.struct(p.alias("text"), F.lit(target).alias("most"), F.lit("\n").alias("glue"), F.lit(False).alias("opens")))
        ),
    )
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("text"), F.lit("").alias("glue"))

    def step(acc: Column, x: Column) -> Column:
        none = acc["text"] == ""
        # Sentences of a long paragraph never share a chunk with what stands before or after it.
        shut = ~none & (x["opens"] | (acc["glue"] != x["glue"]) | (F.length(acc["text"]) + F.length(x["glue"]) + F.length(x["text"]) > x["most"]))
        return F.struct(
            F.when(shut, F.concat(acc["done"], F.array(acc["text"]))).otherwise(acc["done"]).alias("done"),
            F.when(none | shut, x["text"]).otherwise(F.concat(acc["text"], x["glue"], x["text"])).alias("text"),
            x["glue"].alias("glue"),
        )

    return F.aggregate(F.flatten(flat), start, step, lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["text"]))))


def split_paragraphs(c: Column, size: int = TARGET * 4) -> Column:
    """(n, split): paragraphs of a text, and how many of them a cut after every `size` characters would part."""
    text = or_empty(c)
    lines = F.split(text, "\n")
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("split"))

    def step(acc: Column, line: Column) -> Column:
        body = F.trim(line)
        begin = acc["at"] + F.length(line) - F.length(F.ltrim(line))
        end = begin + F.length(body)
        # A multiple of size strictly between begin and end, and within the text.
        cut = F.greatest(F.floor(begin / size) + 1, F.lit(1)) * size
        parted = (body != "") & (cut < end) & (cut < F.length(text))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), (acc["n"] + (body != "").cast("int")).alias("n"), (acc["split"] + parted.cast("int")).alias("split"))

    return F.aggregate(lines, empty, step, lambda acc: F.struct(acc["n"].alias("n"), acc["split"].alias("split")))


def boundary_quality(chunks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """n_boundaries and how many don't follow the end of a sentence; a document's last chunk has no boundary."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    edges = chunks.withColumn("next", F.lead(text).over(w)).where("next is not null")
    return edges.agg(F.count(F.lit(1)).alias("n_boundaries"), F.count_if(~F.rtrim(F.col(text)).rlike(r"[.!?][\"')\]]?$")).alias("n_bad"))
