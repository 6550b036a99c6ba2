"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

``fold_events`` turns a log into final messages. Columns: conv_id, seq (order of events), turn, role, kind
and text. Kinds: ``message`` (sets a turn's role and text), ``delta`` (appends streamed text to the turn),
``edit`` (replaces the turn's text and discards all later turns said so far), ``regenerate`` (empties the
turn, whose new text follows as deltas, and discards later turns). The log is dealt by conversation once;
sorting, both windows and both groupings use that one exchange.

``render`` writes one string per conversation and the character spans that carry loss (assistant texts).
The template marks turns with ``<s>``, ``[INST]``, ``[/INST]`` and ``</s>``; inside texts and role names
every backslash, ``[`` and ``<`` is written as a backslash and a letter, so no text can spell a mark, and
reading the letters again gives the text back.

A conversation's string is the unit of output, so one conversation is built in one task, whatever its
length; that is the one group that can't be split.

Nulls: null text is empty, a null role is the role "". Null conv_id rows are one conversation; null seq or
turn sorts first. Rows that repeat (conv_id, turn) are turns each, in order of role, then text. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("message", "edit", "regenerate")
CUTS = ("edit", "regenerate")


def as_events(conversations: DataFrame) -> DataFrame:
    """A finished conversation table as a log: each row sets a turn of its own, in order of (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    seq = F.row_number().over(order).cast("long")
    return rows.withColumn("seq", seq).withColumn("turn", F.col("seq")).withColumn("kind", F.lit("message"))


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the messages that stand after all events."""
    rows = events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    later = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("conv_id", "turn")
    cut = F.min(F.when(F.col("kind").isin(*CUTS), F.col("turn"))).over(later)
    stands = F.col("_cut").isNull() | (F.col("turn") <= F.col("_cut"))
    reset = F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).over(same)
    role = F.max(F.when(F.col("kind") == "message", F.struct("seq", "role"))).over(same)["role"]
    rows = rows.withColumn("_cut", cut).where(stands).withColumn("_reset", reset).withColumn("_role", role)
    rows = rows.where(F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset")))
    told = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("seq", told.alias("part"))))
    said = rows.groupBy("conv_id", "turn").agg(
        F.concat_ws("", F.transform(parts, lambda x: x["part"])).alias("text"), F.coalesce(F.max("_role"), F.max("role")).alias("role")
    )
    return said.select("conv_id", "turn", "role", "text")


#: Characters that marks and escapes are made of, and what stands for them inside texts.
CODES = (("\\", "\\b"), ("[", "\\s"), ("<", "\\l"))


def escaped(text: Column) -> Column:
    for raw, code in CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss array of (start, length): code points from 0, of escaped assistant texts.

    A turn is ``<s>[INST]`` role ``[/INST]`` text ``</s>``."""
    before, between, after = "<s>[INST]", "[/INST]", "</s>"
    turn = messages.select(
        "conv_id",
        "turn",
        (F.col("role") == "assistant").alias("learn"),
        F.concat(F.lit(before), escaped(F.col("role")), F.lit(between)).alias("head"),
        escaped(F.col("text")).alias("body"),
    )
    whole = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(after))
    turn = turn.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(whole), F.lit(0).cast("long")))
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    rows = F.array_sort(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(after)).alias("part"))))
    return turn.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(rows, lambda x: x["part"])).alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    # An escaped text holds no "<" or "[", so the marks alone cut the string.
    turns = F.filter(F.split(formatted, "</s>", -1), lambda x: x != "")
    parts = F.transform(turns, lambda x: F.split(x, r"\[/INST\]", -1))
    return F.transform(parts, lambda x: F.struct(unescaped(F.substr(x[0], F.lit(len("<s>[INST]") + 1))).alias("role"), unescaped(x[1]).alias("text")))


def chat_format(events: DataFrame) -> DataFrame:
    return render(fold_events(events))
