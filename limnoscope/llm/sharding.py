"""Balanced shards by sampled splitters, in column expressions and windows only.

Rows are ordered by (hash of the text, hash of the row), so equal texts are neighbours and a large group of copies can be
split between any two of them, repeated rows and rows without an id too. Splitters are quantiles of a sample in which a row's chance grows with its size; rows are dealt into
the ranges between them, and ranges that came out overfull are subdivided by splitters of their own. With the ranges'
sizes known, every row's place in the whole order follows from a window inside its range.

Law `bytes`: a row goes to the shard whose share of the running total holds the row's middle. A group of equal texts across such an end
moves whole to the nearer side if it is at most `whole_group` of a shard; larger groups are split there.

Defined results: a null text has size 1 and crc 0 and is ordered with the empty texts; repeated rows and rows
without an id each take a slot of their own; extra columns are not returned; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnoscope.llm.rows import settled

#: Bytes of one range as wanted, and the most ranges to begin with: beyond, ranges grow instead. A range's task holds 60
#: bytes a row, not the texts, and splitters, their sample and the ranges' order stay as small as this bound.
RANGE_BYTES = 4_000_000
MOST_RANGES = 2_048
OVERSAMPLE = 24
OVERFULL = 2.0


def _sample(rows: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int]]:
    """About `wanted` places (key, tie), each row with a chance in proportion to its size; never many more."""
    chance = F.col("size") * (wanted / max(total, 1))
    draw = (F.abs(F.xxhash64("key", "tie", F.lit(seed))) % (1 << 40)) / float(1 << 40)
    return sorted((r.key, r.tie) for r in rows.where(draw < chance).select("key", "tie").collect())


def _splitters(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    picked = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    return sorted(set(picked))


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of splitters at or before the row: a coarse step over every m-th splitter, then a step among m."""
    if not bounds:
        return F.lit(0)
    m = max(1, math.isqrt(len(bounds)))
    kind = "array<struct<key:bigint,tie:bigint>>"

    def held(part: list[tuple[int, int]]) -> str:
        return "array(" + ", ".join(f"named_struct('key', {k}L, 'tie', {t}L)" for k, t in part) + ")"

    fix = lambda s: s.replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
    blocks = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    heads = F.expr(f"cast({fix(held([b[0] for b in blocks]))} as {kind})")
    inner = F.expr(f"cast(array({fix(', '.join(held(b) for b in blocks))}) as array<{kind}>)")
    place = F.struct(F.col("key"), F.col("tie"))
    block = F.size(F.filter(heads, lambda s: s <= place))
    within = F.size(F.filter(F.get(inner, block - 1), lambda s: s <= place))
    return F.when(block == 0, 0).otherwise((block - 1) * m + within)


def shards(docs: DataFrame, count: int = 8, whole_group: float = 0.01, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = settled(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            # Copies are told apart by a hash of their id and their place in the settled table, which spreads them evenly.
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("tie"),
        )
    )
    out = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], out)

    parts = min(max(1, math.ceil(total / range_bytes)), MOST_RANGES)
    bounds = _splitters(_sample(rows, total, parts * OVERSAMPLE, 1), parts)
    seed = 1
    while True:
        ranged = rows.withColumn("range", _range_of(bounds))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        full = [r for r in sums.where((F.col("bytes") > OVERFULL * total / parts) & (F.col("n") > 1)).collect()]
        more = set()
        if full:
            seed += 1
            share = sum(r.bytes for r in full)
            wide = {r.range: r.bytes for r in full}
            drawn = _sample(ranged.where(F.col("range").isin(list(wide))), share, math.ceil(share / total * parts * OVERSAMPLE), seed)
            inside: dict[int, list] = {}
            for place in drawn:
                inside.setdefault(bisect_right(bounds, place), []).append(place)
            for r, places in inside.items():
                more |= set(_splitters(places, max(2, math.ceil(wide.get(r, 0) * parts / total))))
            more -= set(bounds)
        if not more:
            break
        bounds = sorted(set(bounds) | more)

    # One row per range: where it begins in the whole order.
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "range", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before")
    )
    inside_range = Window.partitionBy("range").orderBy("key", "tie", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = settled(
        ranged.withColumn("upto", F.sum("size").over(inside_range))
        .withColumn("nth", F.count("*").over(inside_range))
        .join(starts, "range")
        .select(
            "doc_id", "size", "text_crc32", "key",
            (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"),
            (F.col("rows_before") + F.col("nth") - 1).alias("at"),
        )
    )
    cuts = [total * k / count for k in range(1, count)]

    def by_cut() -> Column:
        """Ends of shards at or before the row's middle."""
        middle = F.col("start") + F.col("size") / 2
        return sum(((middle >= F.lit(float(c))).cast("int") for c in cuts), F.lit(0))

    # Groups that lie across a cut: one per cut at most.
    across = (
        placed.groupBy("key")
        .agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("last"), F.min(by_cut()).alias("a"), F.max(by_cut()).alias("b"))
        .where("a <> b")
        .collect()
    )
    target = total / count
    for g in across:
        if g.last - g.first <= whole_group * target:
            for k, cut in enumerate(cuts):
                if g.first < cut < g.last:
                    cuts[k] = g.first if cut - g.first <= g.last - cut else g.last
    cuts = sorted(cuts)
    sharded = placed.withColumn("shard", by_cut())
    firsts = sharded.groupBy("shard").agg(F.min("at").alias("first_at"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.col("first_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
