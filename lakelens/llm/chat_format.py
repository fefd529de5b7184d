"""Operator 1, chat formatting: turns become one marked-up text per conversation, with the spans that a loss may see.

Native: DataFrame expressions only. Turns of a conversation are collected as structs and sorted, runs of one role
merge into one message by array expressions, and messages are concatenated.

Layout of a message:  <|im_start|>ROLE\\nTEXT(<|im_sep|>TEXT)*<|im_end|>\\n
The separator keeps the texts of merged turns apart, so that reading back loses nothing. Within texts and roles every
"<", any number of backslashes, "|" gets one backslash more; so no text can hold a control string, and dropping that
backslash restores it. Roles also escape "%" and line feeds as %25 and %0A.

Defined results: null text or role is empty; null turns come first; equal turns order by role, then text; repeated
rows are kept as turns; a null conv_id is one conversation of its own; texts of any length are formatted whole, up to the
two gigabytes of a value for a conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def _quoted(marker: str) -> str:
    return marker.replace("|", "\\|")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points, one for each turn of a loss role.

    A span holds the escaped text of one turn only: no marker, role or separator.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get(F.col("turns"), i.cast("int"))
    n = F.size("turns")
    chats = chats.withColumn(
        "heads",  # index of the first turn of each run of one role
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"])),
    )
    chats = chats.withColumn(
        "messages",
        F.transform(
            "heads",
            lambda head, k: F.struct(
                at(head)["role"].alias("role"),
                F.transform(
                    F.slice("turns", head + 1, F.coalesce(F.get(F.col("heads"), (k + 1).cast("int")), n) - head),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    ).drop("turns", "heads")
    head_of = lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))
    formatted = F.array_join(
        F.transform("messages", lambda m: F.concat(head_of(m), F.array_join(m["texts"], SEP), F.lit(END))), ""
    )
    #: Per turn: code points before its text since the previous text, its length, whether a loss sees it.
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m, k: F.transform(
                m["texts"],
                lambda x, j: F.struct(
                    F.when(j > 0, F.lit(len(SEP)))
                    .otherwise(F.length(head_of(m)) + F.when(k > 0, F.lit(len(END))).otherwise(0))
                    .cast("bigint")
                    .alias("gap"),
                    F.length(x).cast("bigint").alias("length"),
                    m["role"].isin(*loss_roles).alias("loss"),
                ),
            ),
        )
    )
    zero = F.lit(0).cast("bigint")
    spans = F.aggregate(
        pieces,
        F.struct(zero.alias("end"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["end"] + p["gap"] + p["length"]).alias("end"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["end"] + p["gap"]).alias("start"), p["length"].alias("length"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Reads formatted texts back: adds turns, an array of (role, text) as they went in, and loss_texts, the unescaped spans."""
    blocks = F.filter(F.split("formatted", _quoted(START)), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        head = F.length(role) + 1
        body = F.substr(block, head + 1, F.length(block) - head - len(END))
        return F.transform(
            F.split(body, _quoted(SEP)), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text"))
        )

    return formatted.withColumns(
        {
            "turns": F.flatten(F.transform(blocks, turns_of)),
            "loss_texts": F.transform(
                "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
            ),
        }
    )
