"""Preference formatting of paired conversations, in DataFrame operations only.

Chosen and rejected conversations of a pair are compared turn by turn; the turns before the first one that differs
(in role or text, or because one side has ended) are their common prefix. The prefix is rendered once as the prompt,
what remains of each side as its completion. Loss is taken on assistant turns of completions alone.

`format_preferences` gives a row a turn, so that a conversation of any length is spread over tasks. `assemble` joins
them to paired rows: prompt, both completions, and the mask of each. A row takes 64 turn numbers of a pair, so that no row
and no group grows with the longest conversation.

`against_others` makes pairs of plain conversations: the rejected side has the last assistant turn of another one.

Null role and null text count as empty. Turns are ordered by number; of turns that share a number in one conversation,
order is by role, then text, and repeated ones are all kept. A pair with one side only has no prompt, and all turns
of that side are its completion; a pair of equal sides is all prompt. Rows without a conversation or turn number are
left out. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def paired_turns(turns: DataFrame, pair: Column, chosen: Column, conv: str = "conv_id") -> DataFrame:
    """turns (conv, turn, role, text) to (pair_id, chosen, turn, nth, role, text); nth numbers turns of one number."""
    own = turns.where(F.col(conv).isNotNull() & F.col("turn").isNotNull()).select(
        pair.alias("pair_id"), chosen.alias("chosen"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    same = Window.partitionBy("pair_id", "chosen", "turn").orderBy("role", "text")
    return own.withColumn("nth", F.row_number().over(same))


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, conv: str = "conv_id") -> DataFrame:
    """(pair_id, part, turn, nth, role, rendered, loss): part is prompt, chosen or rejected; loss 1 where trained on."""
    own = paired_turns(turns, pair, chosen, conv)
    sides = own.groupBy("pair_id", "turn", "nth").agg(
        F.max(F.when(F.col("chosen"), F.struct("role", "text"))).alias("a"),
        F.max(F.when(~F.col("chosen"), F.struct("role", "text"))).alias("b"),
    )
    place = F.struct("turn", "nth")
    differs = F.when(~F.col("a").eqNullSafe(F.col("b")), place)
    firsts = sides.groupBy("pair_id").agg(F.min(differs).alias("first"))
    at = own.join(firsts, "pair_id").withColumn("shared", F.col("first").isNull() | (place < F.col("first")))
    part = F.when(F.col("shared"), "prompt").when(F.col("chosen"), "chosen").otherwise("rejected")
    return at.where(F.col("chosen") | ~F.col("shared")).select(
        "pair_id", part.alias("part"), "turn", F.col("nth").cast("int").alias("nth"), "role",
        render(F.col("role"), F.col("text")).alias("rendered"),
        (~F.col("shared") & (F.col("role") == "assistant")).cast("int").alias("loss"),
    )


def against_others(turns: DataFrame, partner: Column, conv: str = "conv_id") -> DataFrame:
    """turns (conv, turn, role, text) to the same with `chosen`: each conversation as it is, and once more with its last
    assistant turn replaced by that of the conversation `partner` names; without one, the rejected side ends before it."""
    own = turns.where(F.col(conv).isNotNull() & F.col("turn").isNotNull()).select(
        F.col(conv), partner.alias("__partner"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    lasts = own.groupBy(conv, "__partner").agg(F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("last"))
    others = lasts.select(F.col(conv).alias("__partner"), F.col("last.text").alias("instead"))
    swaps = lasts.where("last is not null").join(others, "__partner", "left").select(conv, "last", "instead")
    met = own.join(swaps, conv, "left")
    swapped = (F.col("role") == "assistant") & F.struct("turn", "text").eqNullSafe(F.col("last"))
    sides = F.array(
        F.struct(F.lit(True).alias("chosen"), F.col("text").alias("said")),
        F.struct(F.lit(False).alias("chosen"), F.when(swapped, F.col("instead")).otherwise(F.col("text")).alias("said")),
    )
    both = met.select(conv, "turn", "role", F.explode(sides).alias("s"))
    return both.where("s.said is not null").select(conv, "turn", "role", F.col("s.said").alias("text"), "s.chosen")


def assemble(rows: DataFrame) -> DataFrame:
    """(pair_id, piece, n_prompt, prompt, chosen, rejected, chosen_mask, rejected_mask), rows of format_preferences paired.

    A mask lists loss:characters of each turn of a completion, so that it covers the completion. The turns 64 k to
    64 k + 63 of a pair, 64 of each number at most, are a piece, and pieces ascend: one rule for pairs of any length, which
    puts most of them into one row.
    """
    piece = F.floor(F.col("turn") / 64) * F.lit(1 << 31) + F.floor((F.col("nth") - 1) / 64)
    turns = F.sort_array(F.collect_list(F.struct("turn", "nth", "part", "rendered", "loss")))
    held = rows.groupBy("pair_id", piece.cast("long").alias("piece")).agg(turns.alias("t"))
    of = lambda part: F.filter("t", lambda x: x["part"] == part)
    text = lambda part: F.array_join(F.transform(of(part), lambda x: x["rendered"]), "")
    run = lambda x: F.concat(x["loss"].cast("string"), F.lit(":"), F.char_length(x["rendered"]).cast("string"))
    mask = lambda part: F.array_join(F.transform(of(part), run), ",")
    return held.select(
        "pair_id", "piece", F.size(of("prompt")).alias("n_prompt"), *(text(p).alias(p) for p in ("prompt", "chosen", "rejected")),
        *(mask(p).alias(f"{p}_mask") for p in ("chosen", "rejected")),
    )
