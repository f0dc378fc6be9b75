"""Operator 1: chat formatting with DataFrame expressions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings.  Each starts with ``<`` or ``[``, and no other character follows at once but letters or ``/``; inside texts and roles
    every ``<``, ``[`` and backslash gets a backslash after it, so no control string can arise there, and what follows can be undone."""

    begin: str = "<s>"
    end: str = "</s>"
    turn: str = "[INST]"
    said: str = "[SAYS]"
    again: str = "[NEXT]"
    close: str = "[/INST]"
    loss_role: str = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", r"$1")


def format_chats(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, formatted, loss): one row per conversation.

    ``formatted``: begin, then for each run of turns with one role: turn, role, said, the texts with ``again`` between them, close; then end.
    ``loss``: spans (start from 0, length, in code points of ``formatted``) of the texts of ``template.loss_role``, in order.

    Turns are sorted by number, then role and text (ties, repeated rows: all stay; null numbers first).  Null text and null role count as empty; empty
    texts keep their place and have spans of length 0.  Null ids are one conversation.  Other columns, whatever their names, are not looked at; an empty
    table gives no rows.  A conversation, however long, is one output row, so it must fit into one; texts of any length within that.
    """
    t = template
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    told = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # where a run starts: the places in the sorted turns where the role changes; then slices between them
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    told = told.withColumn("starts", starts).withColumn("ends", F.array_append(F.slice("starts", 2, F.size("starts")), F.size("turns")))
    runs = F.zip_with("starts", "ends", lambda a, b: F.struct(F.get("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda x: x["text"]).alias("texts")))
    told = told.withColumn("runs", runs)
    head = lambda r: F.concat(F.lit(t.turn), escape(r["role"]), F.lit(t.said))
    pieces = F.transform("runs", lambda r: F.concat(head(r), F.array_join(r["texts"], t.again), F.lit(t.close)))
    told = told.withColumn("formatted", F.concat(F.lit(t.begin), F.array_join(pieces, ""), F.lit(t.end)))
    # lengths of what stands before each text, added up along the turns
    steps = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(
                r["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.length(head(r))).otherwise(len(t.again)).alias("lead"),
                    F.length(x).alias("length"),
                    F.when(i == F.size(r["texts"]) - 1, len(t.close)).otherwise(0).alias("trail"),
                    (r["role"] == t.loss_role).alias("loss"),
                ),
            ),
        )
    )
    told = told.withColumn("steps", steps)
    ends = F.aggregate(
        "steps",
        F.struct(F.lit(len(t.begin)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["lead"] + x["length"] + x["trail"]).alias("at"),
            F.when(x["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + x["lead"]).alias("start"), x["length"].alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return told.select(F.col("id").alias(id_col), "formatted", ends["spans"].alias("loss"))


def read_chats(formatted: Column, template: Template = Template()) -> Column:
    """The turns, array<struct<role, text>>, that a formatted text was made of."""
    t = template
    body = F.substring(formatted, F.lit(len(t.begin) + 1), F.length(formatted) - len(t.begin) - len(t.end))
    split = lambda text, by: F.split(text, "\\Q" + by + "\\E", -1)
    runs = F.filter(split(body, t.close), lambda r: r != "")
    opened = F.transform(runs, lambda r: split(F.substring(r, F.lit(len(t.turn) + 1), F.length(r)), t.said))
    return F.flatten(F.transform(opened, lambda p: F.transform(split(F.get(p, F.lit(1)), t.again), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text")))))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
