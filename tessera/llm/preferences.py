"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt. What
follows on either side is that side's completion; its mask has the spans of the assistant's turns,
end marker included, as code point offsets ``start:end`` into the completion, and all else isn't learnt from.

Nulls: a null role is ``unknown``, a null text is empty, a null turn sorts first; rows with a null conversation belong to none and
are left out. Turns are ordered by number, then role, then text; repeated rows are turns of their own.
A side that is missing has a null completion and mask, and then the prompt is empty. If one side is a prefix of the other (or equal), its completion is
empty. An empty table gives an empty result. A conversation's turns meet in one row, never those of different pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant's text in the rendering of ``turns``."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = F.length(F.concat(F.lit("<|"), turn["role"], F.lit("|>\n")))
        low, high = state["at"] + head, state["at"] + F.length(_render(turn))
        span = F.concat(low.cast("string"), F.lit(":"), high.cast("string"))
        return F.struct(high.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, begin, step)["spans"], ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    row = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), row))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), row))).alias("r")
    )
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    each = each.withColumn("k", F.when((F.size("c") == 0) | (F.size("r") == 0), F.lit(0)).when(first == 0, F.size("c")).otherwise(first - 1).cast("int"))
    rest = {side: F.slice(F.col(side), F.col("k") + 1, F.greatest(F.size(side), F.lit(1))) for side in ("c", "r")}
    there = {side: F.size(side) > 0 for side in ("c", "r")}
    return each.select(
        "pair_id", F.col("k").cast("long").alias("n_prompt_turns"), _text(F.slice("c", 1, F.col("k"))).alias("prompt"),
        F.when(there["c"], _text(rest["c"])).alias("chosen"), F.when(there["r"], _text(rest["r"])).alias("rejected"),
        F.when(there["c"], _mask(rest["c"])).alias("chosen_mask"), F.when(there["r"], _mask(rest["r"])).alias("rejected_mask"),
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Conversation 2k is chosen over 2k + 1."""
    return conversations.select(F.expr("conv_id div 2").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
