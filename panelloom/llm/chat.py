"""Preference formatting: what a chosen and a rejected conversation share is the prompt, what follows are the completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, text_of

#: How a turn is written: before its role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: Bits of a number that partners may differ in: those without one among the numbers that share the rest try the next.
REACHES = (16, 32, 48, 64)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def format_preferences(turns: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """One row per pair from turns(pair, chosen, turn, role, text): each turn of the chosen (true) and rejected conversations.

    pair, n_prompt_turns, prompt, chosen, rejected, and for each completion the spans of characters (from 0, end excluded,
    in prompt + completion) that bear loss: the texts and ends of its assistant turns; all else is masked.

    The prompt is the longest common prefix of turns (role and text), rendered once. Turns count in ascending order
    of turn; a turn given twice counts once (its smallest role and text); null roles and texts are empty, null turn numbers come
    first. A side without turns gives an empty completion. The prefix is found by aggregation over single turns,
    so only what a row of the result holds is ever brought together.
    """
    t = turns.select(
        F.col(pair_col).alias("pair"), F.coalesce("chosen", F.lit(False)).alias("chosen"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        text_of("role").alias("role"), text_of("text").alias("text"),
    ).filter("pair is not null")
    said = F.struct("role", "text")
    sides = t.groupBy("pair", "turn").agg(
        F.min(F.when(F.col("chosen"), said)).alias("c"), F.min(F.when(~F.col("chosen"), said)).alias("r")
    )
    first_other = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("other")
    entry = F.sort_array(F.collect_list(F.struct("turn", "c", "r")))
    rows = sides.groupBy("pair").agg(first_other, entry.alias("all"))
    same = F.filter("all", lambda x: F.coalesce(x["turn"] < F.col("other"), F.lit(True)))
    rest = F.filter("all", lambda x: F.coalesce(x["turn"] >= F.col("other"), F.lit(False)))
    rows = rows.select("pair", same.alias("same"), rest.alias("rest"))

    def turns_of(column: str, side: str) -> Column:
        return F.transform(F.filter(column, lambda x: x[side].isNotNull()), lambda x: x[side])

    def text(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda x: rendered(x["role"], x["text"])), "")

    rows = rows.select(
        "pair", F.size("same").cast("long").alias("n_prompt_turns"), text(turns_of("same", "c")).alias("prompt"),
        turns_of("rest", "c").alias("ct"), turns_of("rest", "r").alias("rt"),
    )

    def spans(column: str) -> Column:
        """Running offset over the turns, and a span for each assistant turn."""
        start = F.struct(F.length("prompt").cast("long").alias("at"), F.array().cast("array<struct<from:long,to:long>>").alias("spans"))

        def step(state, x):
            low = state["at"] + F.length(x["role"]) + len(OPEN) + len(MIDDLE)
            end = low + F.length(x["text"]) + len(CLOSE)
            span = F.array(F.struct(low.alias("from"), end.alias("to")))
            own = F.when(x["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.alias("at"), own.alias("spans"))

        return F.aggregate(column, start, step, lambda s: s["spans"])

    return rows.select(
        F.col("pair").alias(pair_col), "n_prompt_turns", "prompt", text(F.col("ct")).alias("chosen"), text(F.col("rt")).alias("rejected"),
        spans("ct").alias("chosen_loss"), spans("rt").alias("rejected_loss"),
    )


def partnered(numbers: DataFrame, col: str) -> DataFrame:
    """numbers (distinct long, not null) with partner: another of them, null only where there is no other.

    In each range of 2**16 numbers the next one is the partner, and the first one that of the last. A number that is alone in its
    range looks among those that are alone in theirs within 2**32, and so on, so no task orders more than 65,536 of them.
    """
    out = numbers.withColumn("partner", F.lit(None).cast("long"))
    for bits in REACHES:
        alone = F.col("partner").isNull()
        reach = F.shiftright(F.col(col), bits) if bits < 64 else F.lit(0).cast("long")
        out = out.withColumn(f"{P}alone", alone).withColumn(f"{P}range", F.when(alone, reach).otherwise(F.col(col)))
        group = Window.partitionBy(f"{P}alone", f"{P}range")
        first = F.min(col).over(group)
        following = F.coalesce(F.lead(col).over(group.orderBy(col)), F.when(first != F.col(col), first))
        out = out.withColumn("partner", F.when(alone, following).otherwise(F.col("partner"))).drop(f"{P}alone", f"{P}range")
    return out


def swapped_answers(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns of preference pairs from plain conversations: pair_id, chosen, turn, role, text.

    A conversation up to its last assistant turn is chosen; rejected is the same with that answer replaced by the last answer of
    its partner, the next answered conversation by number. Conversations without an answer and null ids give no pair, nor does
    one that alone is answered.
    """
    t = conversations.select(
        F.col(conv_col).cast("long").alias("pair_id"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text")
    ).filter("pair_id is not null")
    last = (
        t.filter(F.col("role") == "assistant")
        .groupBy("pair_id")
        .agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("answer"))
    )
    partners = partnered(last.select("pair_id"), "pair_id").filter("partner is not null")
    other = last.select(F.col("pair_id").alias("partner"), F.col("answer").alias("other"))
    both = last.join(partners, "pair_id").join(other, "partner").drop("partner")
    own = t.join(both, "pair_id").filter(F.col("turn") <= F.col("last"))
    chosen = own.select("pair_id", F.lit(True).alias("chosen"), "turn", "role", "text")
    answer = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    rejected = own.select("pair_id", F.lit(False).alias("chosen"), "turn", "role", answer.alias("text"))
    return chosen.unionByName(rejected)


__all__ = ["format_preferences", "partnered", "rendered", "swapped_answers"]
