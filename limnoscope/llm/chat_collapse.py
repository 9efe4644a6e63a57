"""Conversations logged again and again as they grow: only the longest snapshot of each stays, rendered as chat text.

A conversation is the set of its distinct turns (turn, role, text) in that order. Every turn gets a rolling hash of the
conversation up to it: the running sums of two 64-bit hashes of its turns, exact in decimals. A conversation whose whole
hash is some longer conversation's prefix hash is a snapshot of it and goes; of equal conversations the smallest id
stays. Both sides of the anti-joins hold distinct hashes, so a first turn that very many conversations share is one row.

Running sums are taken inside blocks and shifted by the blocks before, so one endless conversation is spread over tasks.
Blocks are runs of turn numbers; one that holds very many turns, such as rows without a conversation id or with few turn
numbers, is cut at its own quantiles of (turn, role, beginning of the text). All is column expressions, windows and joins.

Defined results: rows repeated in full count once; turns with one number are ordered by role, then text, nulls first;
a null turn number comes first; null roles and texts are rendered as empty; rows without a conversation id form one
conversation; extra columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from limnoscope.llm.rows import settled

BLOCK = 256
#: Distinct turns of a block from which it is cut, its cuts, and the characters of a text that they compare.
CROWDED = 20_000
CUTS = 64
COMPARED = 256
EXACT = "decimal(38,0)"


def rendered_turn(role, text):
    """One turn as chat text: its role in a header line, the text, an end mark."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _cut_blocks(rows: DataFrame, crowded: int) -> DataFrame:
    """Rows with `part`, the number of the block's cuts at or before the turn; 0 in blocks that are not crowded.

    Cuts are quantiles of some 16 turns per cut drawn by hash, so a crowded block sends a bounded sample.
    """
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size")).where(F.col("size") > crowded)
    hot = settled(sizes.select(F.col("conv_id").alias("id"), F.col("block").alias("at"), "size"))
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0))
    place = F.struct("turn", "role", F.substring("text", 1, COMPARED).alias("text"))
    here = F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("block") == F.col("at"))
    # At most one row per `crowded` turns, with a bounded list of cuts.
    drawn = rows.join(hot.hint("merge"), here).where(F.pmod(F.xxhash64("turn", "role", "text"), F.col("size")) < 16 * CUTS)
    taken = drawn.groupBy("id", "at").agg(F.sort_array(F.collect_list(place)).alias("s"))
    nth = F.transform(F.sequence(F.lit(1), F.lit(CUTS - 1)), lambda k: F.get("s", F.floor(k * F.size("s") / CUTS).cast("int")))
    cuts = taken.select("id", "at", F.array_distinct(nth).alias("cuts"))
    part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda s: s <= place)))
    return rows.join(cuts.hint("merge"), here, "left").withColumn("part", part).drop("id", "at", "cuts")


def hashed_turns(conversations: DataFrame, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Turns with their rolling hashes inside blocks, and one row per (conversation, block, part) with what came before."""
    c = F.col
    rows = conversations.select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"),
        c("role").cast("string").alias("role"), c("text").cast("string").alias("text"),
    ).distinct()
    rows = rows.withColumns(
        {
            "block": F.coalesce(F.floor(c("turn") / BLOCK), F.lit(-(1 << 62))),
            # Nulls and empty texts hash apart.
            "h1": F.xxhash64(F.lit(1), "turn", c("role").isNull(), "role", c("text").isNull(), "text").cast(EXACT),
            "h2": F.xxhash64(F.lit(2), "turn", c("role").isNull(), "role", c("text").isNull(), "text").cast(EXACT),
        }
    )
    rows = _cut_blocks(rows, crowded)
    inside = Window.partitionBy("conv_id", "block", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = rows.withColumns({"k": F.count("*").over(inside), "s1": F.sum("h1").over(inside), "s2": F.sum("h2").over(inside)})
    sums = rows.groupBy("conv_id", "block", "part").agg(F.count("*").alias("n"), F.sum("h1").alias("t1"), F.sum("h2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    zero = F.lit(0).cast(EXACT)
    blocks = sums.select(
        "conv_id", "block", "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t1").over(before), zero).alias("b1"), F.coalesce(F.sum("t2").over(before), zero).alias("b2"),
        F.sum("n").over(whole).alias("n_turns"), F.sum("t1").over(whole).alias("w1"), F.sum("t2").over(whole).alias("w2"),
    )
    return turns, blocks


def maximal_turns(conversations: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(conv_id, n_turns, turn_no, role, text, rendered) of every turn of the conversations that stay."""
    turns, blocks = hashed_turns(conversations, crowded)
    blocks = settled(blocks)
    known = blocks.withColumnsRenamed({"conv_id": "id", "block": "at", "part": "cut"})
    same_block = F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("block") == F.col("at")) & (F.col("part") == F.col("cut"))
    turns = settled(
        turns.join(known, same_block).select(
            "conv_id", "block", "part", "role", "text", "n_turns", (F.col("n0") + F.col("k")).alias("turn_no"),
            (F.col("b1") + F.col("s1")).cast(EXACT).alias("p1"), (F.col("b2") + F.col("s2")).cast(EXACT).alias("p2"),
        )
    )
    prefixes = turns.where("turn_no < n_turns").select(F.col("turn_no").alias("n_turns"), F.col("p1").alias("w1"), F.col("p2").alias("w2")).distinct()
    # One row per distinct conversation; a null id counts as smallest.
    wholes = blocks.groupBy("n_turns", F.col("w1").cast(EXACT).alias("w1"), F.col("w2").cast(EXACT).alias("w2")).agg(
        F.min(F.struct(F.col("conv_id").isNotNull().alias("named"), F.col("conv_id").alias("id"))).alias("first")
    )
    kept = wholes.join(prefixes, ["n_turns", "w1", "w2"], "left_anti").select(F.col("first.id").alias("kept_id"))
    kept_blocks = blocks.select(F.col("conv_id").alias("id"), F.col("block").alias("at"), F.col("part").alias("cut")).join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return turns.join(kept_blocks, same_block, "left_semi").select(
        "conv_id", "n_turns", "turn_no", "role", "text", rendered_turn(F.col("role"), F.col("text")).alias("rendered")
    )
