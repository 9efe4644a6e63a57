"""Near-duplicate documents by one-permutation hashing with optimal densification and star-shaped candidate edges.

A document's set holds the 64-bit hashes of its word shingles. One hash orders the whole set: its top bits choose one of
`bins` bins, the least hash of each bin is kept, and an empty bin copies the first non-empty bin of its own fixed probe
sequence (optimal densification). `rows` bins make a band; a band's key is a bucket.

Copies with the same set are one node from the start. In each bucket, nodes are paired with the bucket's centre only, so
pairs are bounded by bucket rows; the centre is the node whose buckets are the fullest, which is the text that the others
were copied from rather than one of the copies. First a node checks the centre that it meets in most buckets, then the
centres of all its buckets that still hold several components. Pairs that the stars leave are handled exactly: within a
bucket, nodes outside the largest component meet the nodes of other components. Before a pair leaves that join, its sizes
and the signatures of its sets must allow the similarity (see `signatures`), so pairs that are merely similar go no
further. Links are confirmed on the full sets. Two sets of similarity 0.8 share no bucket with probability
(1 - 0.8**4)**32, about 5e-8; sets of a few shingles, whose bins are copies of each other, are no worse.

Defined results: a null or blank text has an empty set and is linked with nothing; repeated rows and rows that share an
id are one node; a row without an id is linked with nothing and its component is null; extra columns are not returned;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limnoscope.llm import wordhash
from limnoscope.llm.components import connected
from limnoscope.llm.rows import brief_shuffles, free_name, released, settled
from limnoscope.llm.wordhash import U, mix

#: 64-bit words of a set's signature.
SIGNATURE_WORDS = 8


@dataclass(frozen=True)
class Sketch:
    shingle_words: int = 2
    percent: int = 80
    bins: int = 128
    rows: int = 4


def _shingle_sets(texts, size: int):
    """(row, sorted distinct shingle hashes) of each text; fewer words than a shingle make one shingle."""
    for at, end, data, offsets in wordhash.slices(texts):
        h, _, _, first = wordhash.word_hashes(data, offsets, wordhash.SPACED)
        g, where = wordhash.grams(h, first, size)
        lo = np.searchsorted(where, first)
        for k in range(end - at):
            n = first[k + 1] - first[k]
            if n >= size:
                yield at + k, np.unique(g[lo[k] : lo[k + 1]])
            elif n:
                whole = h[first[k] : first[k] + 1] + U(n)
                for j in range(1, n):
                    whole = mix(whole * U(0xD6E8FEB86659FD93) + h[first[k] + j])
                yield at + k, mix(whole)
            else:
                yield at + k, np.zeros(0, U)


def densified(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row from the first full bin of the bin's probe sequence."""
    bins = least.shape[1]
    row, slot = np.nonzero(~full)
    out, attempt = least.copy(), 0
    while len(row):
        attempt += 1
        probe = (mix(slot.astype(U) * U(0x2545F4914F6CDD1D) + U(attempt)) % U(bins)).astype(np.int64)
        hit = full[row, probe]
        out[row[hit], slot[hit]] = least[row[hit], probe[hit]]
        row, slot = row[~hit], slot[~hit]
    return out


def band_keys(sets: list[np.ndarray], sketch: Sketch) -> np.ndarray:
    """Bucket keys of non-empty sets, one row per set."""
    bins = sketch.bins
    edges = np.arange(bins, dtype=U) << U(64 - int(np.log2(bins)))
    least = np.zeros((len(sets), bins), dtype=U)
    full = np.zeros((len(sets), bins), dtype=bool)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        stop = np.append(at[1:], len(s))
        full[k] = at < stop
        least[k, full[k]] = s[at[full[k]]]
    least = densified(least, full)
    bands = bins // sketch.rows
    grouped = least.reshape(len(sets), bands, sketch.rows)
    key = mix(np.arange(bands, dtype=U) + U(77))[None, :].repeat(len(sets), axis=0)
    for j in range(sketch.rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return key


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SIGNATURE_WORDS words per set: every shingle flips one bit.

    A bit differs between two signatures only if an odd number of the shingles that one of the sets lacks fall on it, so
    the sets differ in at least as many shingles as their signatures differ in bits.
    """
    out = np.zeros((len(sets), SIGNATURE_WORDS * 64), dtype=bool)
    for k, s in enumerate(sets):
        out[k] = np.bincount((mix(s ^ U(0x2127599BF4325C37)) % U(out.shape[1])).astype(np.int64), minlength=out.shape[1]) % 2
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def sketches(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys, signature) per document; set_a and set_b identify the set."""

    def run(batches):
        for batch in batches:
            ids, n, a, b, done = batch.column("doc_id"), [], [], [], []
            some, where = [], []

            def finish():
                if some:
                    done.append((list(where), band_keys(some, sketch).view(np.int64), signatures(some)))
                    some.clear()
                    where.clear()

            for row, s in _shingle_sets(batch.column("text"), sketch.shingle_words):
                n.append(len(s))
                a.append(int(mix(s).sum(dtype=U).view(np.int64)) if len(s) else 0)
                b.append(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)) if len(s) else 0)
                if len(s):
                    some.append(s)
                    where.append(row)
                if len(some) >= 2000:
                    finish()
            finish()
            keys: list = [None] * len(n)
            bits: list = [None] * len(n)
            for rows, k, g in done:
                for r, x, y in zip(rows, k, g):
                    keys[r], bits[r] = x, y
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, longs), pa.array(bits, longs)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "signature"],
            )

    kind = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, signature array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def full_sets(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(node, grams) with the whole set of each document."""

    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for _, s in _shingle_sets(batch.column("text"), sketch.shingle_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"]
            )

    return docs.mapInArrow(run, "node long, grams array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): those of `pairs` (node, centre) whose full sets reach the similarity."""
    inter = F.size(F.array_intersect("grams", "centre_grams"))
    return settled(
        pairs.join(sets.hint("merge"), "node")
        .join(sets.toDF("centre", "centre_grams").hint("merge"), "centre")
        .where(F.least(F.size("grams"), F.size("centre_grams")) * 100 >= percent * F.greatest(F.size("grams"), F.size("centre_grams")))
        .select("node", "centre", (F.size("grams") + F.size("centre_grams")).alias("sizes"), inter.alias("inter"))
        .where(100 * F.col("inter") >= percent * (F.col("sizes") - F.col("inter")))
        .select(F.col("node").alias("a"), F.col("centre").alias("b"))
        .repartition("a")
    )


def may_reach(percent: int, n: str, other_n: str, signature: str, other_signature: str):
    """False only for pairs whose sizes or signatures rule the similarity out.

    Of two sets with a union of u, at most (100 - percent) * u / 100 shingles differ, and u is (both sizes + those) / 2.
    """
    sizes = F.least(n, other_n) * 100 >= percent * F.greatest(n, other_n)
    differ = F.aggregate(F.zip_with(signature, other_signature, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return sizes & (differ * (100 + percent) <= (F.col(n) + F.col(other_n)) * (100 - percent))


def _described(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, centre) that sizes and signatures allow."""
    mine = nodes.select("node", "n", "signature").hint("merge")
    its = nodes.select(F.col("node").alias("centre"), F.col("n").alias("centre_n"), F.col("signature").alias("centre_signature")).hint("merge")
    both = pairs.join(mine, "node").join(its, "centre")
    return both.where(may_reach(percent, "n", "centre_n", "signature", "centre_signature")).select("node", "centre")


def _mixed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, fullness, component) of the buckets that hold several components."""
    placed = rows.withColumn("component", F.col("node"))
    if labels is not None:
        placed = rows.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return placed.join(several.hint("merge"), "key", "left_semi")


def _beside_centre(placed: DataFrame) -> DataFrame:
    """(node, centre) for every row of a bucket but its centre's and those of the centre's component."""
    # No two nodes are equally full, so both maxima are the same row's.
    centres = placed.groupBy("key").agg(F.max_by("node", "fullness").alias("centre"), F.max_by("component", "fullness").alias("its"))
    met = placed.join(centres.hint("merge"), "key")
    return met.where("component <> its").select("node", "centre")


def bucket_pairs(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, centre) of different components that share a bucket of `placed` and can reach the similarity.

    Each bucket's largest component meets the others only, so its own pairs are never looked at.
    """
    largest = (
        placed.groupBy("key", "component").agg(F.count("*").alias("size"))
        .groupBy("key").agg(F.max(F.struct("size", "component")).alias("c"))
        .select("key", F.col("c.component").alias("largest"))
    )
    told = placed.select("key", "node", "component").join(nodes.select("node", "n", "signature").hint("merge"), "node").join(largest.hint("merge"), "key")
    told = settled(told.repartition("key"))
    others = told.select("key", *[F.col(c).alias(f"other_{c}") for c in ("node", "component", "n", "signature", "largest")])
    # Two nodes outside the largest component meet twice; once is enough.
    once = (F.col("other_component") == F.col("other_largest")) | (F.col("node") < F.col("other_node"))
    pairs = told.where("component <> largest").join(others.hint("merge"), "key").where(
        (F.col("component") != F.col("other_component")) & once & may_reach(percent, "n", "other_n", "signature", "other_signature")
    )
    found = settled(pairs.select(F.least("node", "other_node").alias("centre"), F.greatest("node", "other_node").alias("node")).distinct())
    released(told)
    return found


def near_duplicates(docs: DataFrame, sketch: Sketch = Sketch()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs` (doc_id, text)."""
    with brief_shuffles(docs.sparkSession):
        return _near_duplicates(docs, sketch)


def _near_duplicates(docs: DataFrame, sketch: Sketch) -> DataFrame:
    seen = settled(sketches(docs, sketch))
    named = seen.where("doc_id is not null and n_shingles > 0")
    classes = settled(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")))
    keyed = named.join(classes.select(F.col("node").alias("doc_id"), "set_a", "set_b").hint("merge"), ["doc_id", "set_a", "set_b"], "left_semi")
    # Rows that share an id give a node several sets; each has its own keys, size and signature.
    keyed = keyed.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "keys", "signature").dropDuplicates(["node", "keys", "signature"])
    rows = keyed.select("node", F.explode("keys").alias("key"))
    # Only buckets with two nodes at least go on.
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "size")
    rows = rows.join(shared.hint("merge"), "key")
    # How full a node's buckets are, with the node as the last digits, so no two nodes are level.
    full = rows.groupBy("node").agg(F.sum("size").cast("decimal(18,0)").alias("size"))
    full = full.select("node", (F.col("size") * F.expr("cast('20000000000000000000' as decimal(20,0))") - F.col("node").cast("decimal(19,0)")).cast("decimal(38,0)").alias("fullness"))
    rows = settled(rows.select("node", "key").join(full.hint("merge"), "node").repartition("node"))
    found = rows.select("node").distinct()
    nodes = settled(keyed.select("node", "n", "signature").join(found.hint("merge"), "node", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = settled(full_sets(texts.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), sketch))

    # What a join leaves in many small split parts is dealt out evenly again before it is kept.
    # Joins are sort-merge joins: a broadcast per join would pile up on the driver.
    links, labels = None, None
    for step in ("likeliest centre", "all centres", "all pairs"):
        placed = settled(_mixed(rows, labels).repartition("node"))
        if placed.isEmpty():
            released(placed)
            break
        if step == "likeliest centre":
            counted = _beside_centre(placed).groupBy("node", "centre").agg(F.count("*").alias("shared"))
            pairs = counted.groupBy("node").agg(F.max(F.struct("shared", "centre")).alias("c")).select("node", "c.centre")
            pairs = settled(_described(pairs, nodes, sketch.percent).distinct())
        elif step == "all centres":
            pairs = settled(_described(_beside_centre(placed).distinct(), nodes, sketch.percent).distinct().repartition("node"))
        else:
            pairs = bucket_pairs(placed, nodes, sketch.percent)
        confirmed = _confirmed(pairs, sets, sketch.percent)
        released(placed, pairs)
        if confirmed.isEmpty():
            released(confirmed)
            continue
        before, links = links, confirmed if links is None else settled(links.unionByName(confirmed))
        if before is not None:
            released(before, confirmed)
        older, labels = labels, connected(links)
        released(older)
    released(rows, nodes, sets, links)

    if labels is not None:
        classes = classes.join(labels.hint("merge"), "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component_id"))
    else:
        classes = classes.withColumnRenamed("node", "component_id")
    # Rows of an empty set or without an id stand alone; the others take the component of their set.
    alone = seen.where("doc_id is null or n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    placed = seen.where("doc_id is not null and n_shingles > 0").join(classes.hint("merge"), ["set_a", "set_b"])
    result = placed.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, sketch: Sketch = Sketch(shingle_words=5)) -> DataFrame:
    """Rows of `docs` (doc_id, text, any others): one document of each group of near copies, the one with the smallest id.

    Only rows of one id and text are one document; different texts that share an id are different documents. A row
    without an id is compared with nothing and stays.
    """
    mark = free_name(docs, "text_md5")
    marked = docs.withColumn(mark, F.coalesce(F.md5(F.col("text")), F.lit("")))
    named = marked.where("doc_id is not null")
    counted = settled(named.groupBy("doc_id", mark).count())
    shared = counted.groupBy("doc_id").count().where("count > 1")
    if shared.isEmpty():
        found = near_duplicates(docs.select("doc_id", "text"), sketch)
        left = marked.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    else:
        # Every text gets a number of its own, in the order of the ids.
        texts = named.select("doc_id", mark, "text").dropDuplicates(["doc_id", mark])
        numbered = settled(texts.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark).withColumn("number", F.monotonically_increasing_id()))
        found = near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), sketch)
        gone = numbered.select("number", "doc_id", mark).join(found.where("not kept").select(F.col("doc_id").alias("number")), "number", "left_semi")
        left = marked.join(gone.select("doc_id", mark), ["doc_id", mark], "left_anti")
    twice = counted.where("count > 1").select("doc_id", mark)
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, ["doc_id", mark], "left_anti").select(*docs.columns)
    row = F.struct(*docs.columns)
    rest = left.join(twice, ["doc_id", mark], "left_semi").groupBy("doc_id", mark).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(rest.select("row.*"))
