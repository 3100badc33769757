"""Preference pairs as training text, in DataFrame operations only.

The turns that a chosen and a rejected conversation begin with in common are
rendered once, as the prompt; what follows in each is its completion, with a mask
of the characters to learn. One shuffle by pair brings a pair's turns together;
everything else is array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _inert(text: Column) -> Column:
    """Text that can't open a marker: a space parts its opening characters."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _inert(F.coalesce(turn["role"], F.lit("unknown"))), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(_inert(turn["text"]), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Lengths of runs, each with 1 if it is to be learnt: an assistant's text and end marker."""

    def runs(t: Column) -> Column:
        learnt = F.when(t["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0"))
        return F.concat(F.length(_head(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"), learnt)

    return F.array_join(F.transform(turns, runs), ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, paired, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask: one row a pair.

    turns(pair_id, chosen boolean, turn, role, text): both conversations of each
    pair. Turns come by turn, then role and text, nulls last; rows that repeat are
    turns of their own. Turns are common if role and text are equal, null being
    equal to null. A mask has <length>:<0 or 1> runs over the completion's code
    points. If one conversation is missing, or both are equal, its completion is
    empty. A null role is rendered as unknown and a null text as nothing. Rows
    without pair_id or side take no part; other columns are ignored, and an empty
    table gives an empty one.
    """
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text", "chosen")
    rows = turns.filter("pair_id IS NOT NULL AND chosen IS NOT NULL").groupBy("pair_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    rows = rows.select("pair_id", F.filter("all", lambda t: t["chosen"]).alias("c"), F.filter("all", lambda t: ~t["chosen"]).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False)).cast("int")
    rows = rows.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(least))
    rest = {s: F.slice(s, F.col("n_common") + 1, F.size(s)) for s in ("c", "r")}
    return rows.select(
        "pair_id",
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("paired"),
        "n_common",
        _render(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        _render(rest["c"]).alias("chosen"),
        _render(rest["r"]).alias("rejected"),
        _mask(rest["c"]).alias("chosen_mask"),
        _mask(rest["r"]).alias("rejected_mask"),
    )


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of pairs for format_pairs: a conversation up to its last assistant turn is chosen; rejected is the same with the last assistant text of the conversation whose id is one more.

    pair_id is conv_id and turn a turn's place, by turn, then role and text, nulls
    last. Turns behind the last assistant turn have no reply to judge and are left
    out. A conversation without an assistant turn is chosen whole, and that or a
    missing next one leaves a pair without rejected turns. Rows without conv_id take
    no part; rows that repeat are turns of their own; other columns are ignored; an
    empty table gives an empty one.
    """
    by = Window.partitionBy("conv_id")
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(by.orderBy(*order)).cast("long"))
    rows = rows.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("place"))).over(by)).filter("last IS NULL OR place <= last")
    replies = rows.filter("place = last").select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("reply"), F.lit(True).alias("found"))
    both = rows.join(replies, "conv_id", "left")
    sides = F.when(F.col("found") & F.col("last").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    both = both.select("*", F.explode(sides).alias("chosen"))
    text = F.when(F.col("chosen") | (F.col("place") < F.col("last")), F.col("text")).otherwise(F.col("reply"))
    return both.select(F.col("conv_id").alias("pair_id"), "chosen", F.col("place").alias("turn"), "role", text.alias("text"))
