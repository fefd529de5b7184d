"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no topic.
STOP_WORDS = (
    "a an the and or but of in on at to for from by with without within into over "
    "under about across between during before after is are was were be been being "
    "do does did doing have has had having how what which who whom whose when where "
    "why that this these those it its as than then there their them they he she his "
    "her you your we our us not no nor if so such can could may might must shall "
    "should will would does project projects question answer eu european union"
).split()
# Acronyms that are no names.
GENERIC_ACRONYMS = ["ERC", "MSCA", "H2020", "FP7", "HORIZON", "SME", "SMES", "ICT", "CSA", "TRL", "III", "EUR"]
ACRONYM = r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9]{2,}(?:-[A-Z0-9]+)*(?![\p{L}\p{N}_])"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
# The entities that a careless copy leaves in a text.
HTML_ENTITY = r"&(?:lt|gt|amp|quot|apos|nbsp|#[0-9]+|#x[0-9a-fA-F]+);"
#: The spaces of Unicode (category Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: A citation such as [NAME, 123], with its id.
CITATION = r"\[[^\[\],]+,\s*(\d+)\]"
#: SQL in pieces: quoted texts, names with what follows them, and what compares.
QUOTED = r"'((?:[^']|'')*)'"
COMPARED = r"(?i)([A-Za-z_]\w*)\s*(?:[<>=]|!=|(?:not\s+)?(?:like|ilike|in|between)\b)"
#: Longer quoted texts are prose, not values.
LONGEST_LITERAL = 80


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def has_text(*cols: Column) -> Column:
    """Whether any column holds more than blanks."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols]).isNotNull()


def sweep(*cols: Column) -> Column:
    """All columns as one text for matching, nulls as empty."""
    return F.concat_ws(" ", *[or_empty(c) for c in cols])


def lower(c: Column) -> Column:
    """Lower case, character by character. The JVM makes two characters of a dotted capital I, and a capital sigma's lower
    case depends on where it stands in its word."""
    return F.lower(F.replace(F.replace(c, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def alnum_tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(lower(or_empty(c)), "[^a-z0-9]+"), "")


def topic_words(c: Column) -> Column:
    """Distinct tokens of more than two characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(alnum_tokens(c), lambda w: F.length(w) > 2), stop)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, also where the body's own lambdas refer to it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _flat(c: Column) -> Column:
    """Lower case, runs of white space as one space, and none of Unicode's spaces at the ends."""
    return F.btrim(F.regexp_replace(lower(or_empty(c)), r"[\t\n\f\r ]+", " "), F.lit(SPACES))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _codes(texts: pa.Array) -> pa.Array:
    found = []
    for text in texts.to_pylist():
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        found.append(np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]))
    code = np.concatenate([np.zeros(0, np.uint64), *found])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # one to one
        code = (code ^ code >> np.uint64(shift)) * np.uint64(factor)
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.view(np.int64)))


def trigram_codes(c: Column) -> Column:
    """The trigrams of a text as 64-bit numbers that look random: equal ones are equal trigrams."""
    return _codes(_flat(c))


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of the lower-case text with single spaces."""

    def cut(x: Column) -> Column:
        three = F.transform(F.sequence(F.lit(2), F.size(x) - 1), lambda i: F.concat(F.get(x, i - 2), F.get(x, i - 1), F.get(x, i)))
        return F.when(F.size(x) >= 3, F.array_distinct(three)).otherwise(F.expr("cast(array() as array<string>)"))

    return let(F.array_remove(F.split(_flat(c), ""), ""), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def paragraphs(c: Column) -> Column:
    """Lines that hold more than blanks, trimmed."""
    return F.filter(F.transform(F.split(or_empty(c), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Pieces after an end mark, an optional closing quote or bracket, and white space; blanks trimmed."""
    cut = F.regexp_replace(or_empty(c), r"([.!?][\"')\]]?)\s+", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def raw_sentences(c: Column) -> Column:
    """Sentences that keep the one white space character after their end mark, so that they concatenate to the text."""
    cut = F.regexp_replace(or_empty(c), r"([.!?][\"')\]]?\s)", "$1\u0001")
    return F.filter(F.split(cut, "\u0001"), lambda s: s != "")


def windows(c: Column, size: int, overlap: int = 0) -> Column:
    """Pieces of `size` characters that start every size - overlap characters."""
    step = size - overlap
    n = F.length(c)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.substr(c, i + 1, F.lit(size)))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def acronyms(c: Column) -> Column:
    """Distinct acronym-like names, without the generic ones."""
    found = F.regexp_extract_all(or_empty(c), F.lit(ACRONYM), 0)
    return F.array_except(found, F.array(*[F.lit(x) for x in GENERIC_ACRONYMS]))


def filter_axes(sql: Column) -> Column:
    """Columns that a statement compares with something, but for ids; lower case, sorted. Quoted texts don't count."""
    bare = F.regexp_replace(or_empty(sql), QUOTED, "''")
    names = F.transform(F.regexp_extract_all(bare, F.lit(COMPARED), 1), lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: ~x.isin("id", "projectid", "not", "and", "or", "where"))))


def quoted_literals(sql: Column) -> Column:
    """Distinct quoted texts of a statement that hold more than blanks, up to LONGEST_LITERAL characters."""
    found = F.regexp_extract_all(or_empty(sql), F.lit(QUOTED), 1)
    return F.array_distinct(F.filter(found, lambda v: (F.trim(v) != "") & (F.length(v) <= LONGEST_LITERAL)))


def numbers(c: Column) -> Column:
    """Numbers as written, without thousands separators."""
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))


def html_entities(c: Column) -> Column:
    return F.regexp_extract_all(or_empty(c), F.lit(HTML_ENTITY), 0)


def entity_contexts(c: Column, around: int = 40) -> Column:
    """(entity, context) of each entity: where it stands, with up to `around` characters on both sides, single-spaced."""
    text = or_empty(c)
    # Every other piece of the text cut at entities is one of them.
    pieces = F.split(F.regexp_replace(text, f"({HTML_ENTITY})", "\u0001$1\u0001"), "\u0001")

    def hits(x: Column) -> Column:
        def one(i: Column) -> Column:
            before = F.array_join(F.slice(x, F.lit(1), i), "")
            after = F.array_join(F.slice(x, i + 2, F.size(x)), "")
            cut = F.concat(F.right(before, F.lit(around)), F.get(x, i), F.left(after, F.lit(around)))
            return F.struct(F.get(x, i).alias("entity"), F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("context"))

        places = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: i % 2 == 1)
        return F.transform(places, one)

    return let(pieces, hits)


def fingerprint(c: Column) -> Column:
    """The first twelve hex digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 12)


def header(acronym: Column, title: Column, section: Column) -> Column:
    return F.concat(or_empty(acronym), F.lit(" - "), or_empty(title), F.lit(" | "), or_empty(section))


def cited_ids(c: Column) -> Column:
    """Ids of citations such as [NAME, 123]."""
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(CITATION), 1), lambda x: x.cast("bigint"))


def month_boundaries(a: Column, b: Column) -> Column:
    """Calendar month boundaries between two dates."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
