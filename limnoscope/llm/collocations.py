"""Collocations by prefix-free parsing.

A piece of text is cut into chunks at its own content: wherever the hash of the next four words is divisible by
`modulus`, a chunk ends after those four words and the next one begins before them. Neighbouring chunks hence overlap by
four words, the same passage gives the same chunks wherever it stands, and no phrase of up to five words crosses a cut.
Distinct chunks form a dictionary with parse frequencies. Phrases are counted inside distinct chunks, weighted by those
frequencies; a phrase that begins in an overlap belongs to the later chunk, so it is counted once.

A phrase can only be seen `fewest` times if all its parts are. Words are counted first, then pairs of frequent words, then
phrases of three to five words whose pairs are all frequent. What is frequent goes to the tasks as a bit filter of a fixed
size; it never misses a frequent part, and what it lets through by chance falls to the counts, so results are exact at
every size of corpus and filter.

Defined results: null and empty texts hold no words; a null lang counts as `und`; repeated rows count again; ties of a
score fall to the smallest cut, ties of rank to the smaller phrase; extra columns are not looked at; an empty table gives
no rows. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from limnoscope.llm import wordhash
from limnoscope.llm.rows import brief_shuffles, settled
from limnoscope.llm.wordhash import FOLD, U, mix
from limnoscope.session import scratch_path

#: Bytes that end a piece, and those that stand between words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Words copied at a time.
BLOCK = 200_000


@dataclass(frozen=True)
class Mining:
    most_words: int = 5
    fewest: int = 100
    modulus: int = 16
    top: int = 2000
    #: Bits of a filter of frequent parts, as a power of two: 8 MB.
    filter_bits: int = 26


def _table(no_word: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(no_word)] = False
    return out


ENDING = ~_table(ENDS)
WORD = _table(ENDS + b" \t")
IN_CHUNK = _table(b" ")


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given ranges one after the other."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _cuts(h: np.ndarray, pieces: np.ndarray, overlap: int, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, owned words, words) of each chunk; `pieces` holds the first word of each piece and the end."""
    window, at = wordhash.grams(h, pieces, overlap)
    begins = np.union1d(pieces[:-1], at[window % U(modulus) == 0])
    follows = np.append(begins[1:], pieces[-1])
    final = np.isin(follows, pieces)
    return begins, follows - begins, follows - begins + np.where(final, 0, overlap)


def chunks_of(texts: pa.Array, overlap: int, modulus: int):
    """(row, chunks, owned words) of consecutive chunks of the texts; words of a chunk are joined by one space."""
    for at, _, data, offsets in wordhash.slices(texts):
        h, start, end, first = wordhash.word_hashes(data, offsets, WORD)
        if not len(h):
            continue
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        piece = np.searchsorted(np.flatnonzero(ENDING[data]), start) + row
        pieces = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(h)]])
        begins, owned, size = _cuts(h, pieces, overlap, modulus)
        block = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), BLOCK))
        for lo, hi in zip(block, np.append(block[1:], len(begins))):
            if lo == hi:
                continue
            n, b = size[lo:hi], begins[lo:hi]
            stops = np.cumsum(n)
            word = np.repeat(b - (stops - n), n) + np.arange(stops[-1])
            # Every word but a chunk's last takes the byte after it along, which becomes the space.
            last = np.zeros(len(word), dtype=bool)
            last[stops - 1] = True
            more = end[word] + ~last
            out, offs = gathered(np.append(data, np.uint8(0)), start[word], more)
            out = FOLD[out]
            out[offs[1:][~last] - 1] = 0x20
            yield at + row[b], _strings(out, np.concatenate([[0], offs[stops]])), owned[lo:hi]


def parse(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, chunk, owned) for every chunk of the parse of `docs` (lang, text)."""

    def run(batches):
        for batch in batches:
            for row, chunk, owned in chunks_of(batch.column("text"), mining.most_words - 1, mining.modulus):
                lang = batch.column("lang").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([lang, chunk, pa.array(owned.astype(np.int32))], names=["lang", "chunk", "owned"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, chunk string, owned int")


def dictionary(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, chunk, owned, seen): the distinct chunks with their parse frequencies, written to the shared folder."""
    path = scratch_path(docs.sparkSession, "chunks")
    distinct = parse(docs, mining).groupBy("lang", "chunk", "owned").agg(F.count("*").alias("seen"))
    distinct.write.parquet(path)
    return docs.sparkSession.read.schema(distinct.schema).parquet(path)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    listed = pc.dictionary_encode(langs)
    one = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in listed.dictionary.to_pylist()]
    return np.array(one or [0], dtype=U)[listed.indices.to_numpy(zero_copy_only=False)]


def _places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = U((1 << bits) - 1)
    return [key & mask, mix(key + U(1)) & mask, mix(key + U(2)) & mask]


def _held(cells: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """True where the filter holds the key; never False for a key that was put in."""
    out = np.ones(len(key), dtype=bool)
    for p in _places(key, bits):
        out &= (cells[p >> U(6)] >> (p & U(63))) & U(1) == 1
    return out


def _keys(texts: pa.Array, langs: pa.Array, size: int):
    """Word places of a slice of chunks and the keys of all runs of `size` words, with their first word."""
    hashes = _lang_hashes(langs)
    for at, end, data, offsets in wordhash.slices(texts):
        h, start, stop, first = wordhash.word_hashes(data, offsets, IN_CHUNK)
        g, where = wordhash.grams(h, first, size)
        row = np.repeat(np.arange(at, end), np.diff(first))
        yield data, start, stop, first, row, mix(g ^ hashes[row[where]]), where


def filter_of(frequent: DataFrame, words: int, bits: int) -> np.ndarray:
    """Bit filter of the phrases of `frequent` (lang, phrase), all of so many words: 2**bits / 8 bytes at any size."""

    def run(batches):
        for batch in batches:
            for *_, key, _ in _keys(batch.column("phrase"), batch.column("lang"), words):
                p = np.concatenate(_places(key, bits))
                bit = (U(1) << (p & U(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((p >> U(6)).view(np.int64)), pa.array(bit)], names=["cell", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    cells = np.zeros(max(1, 1 << (bits - 6)), dtype=U)
    cells[rows["cell"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return cells


def phrases(chunks: DataFrame, frequent: DataFrame, part: int, sizes: range, mining: Mining) -> DataFrame:
    """(lang, phrase, f) of the phrases of `sizes` words seen often enough, whose parts of `part` words are in `frequent`."""
    held = chunks.sparkSession.sparkContext.broadcast(filter_of(frequent, part, mining.filter_bits))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            owned, seen = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owned", "seen"))
            for data, start, stop, first, row, key, where in _keys(batch.column("chunk"), batch.column("lang"), part):
                ok = np.zeros(len(start) + mining.most_words, dtype=bool)
                ok[where[_held(held.value, key, mining.filter_bits)]] = True
                inside = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first)) < owned[row]
                left = np.repeat(first[1:], np.diff(first)) - np.arange(len(start))
                for size in sizes:
                    keep = inside & (left >= size)
                    for k in range(size - part + 1):
                        keep &= ok[k : k + len(start)]
                    at = np.flatnonzero(keep)
                    for lo in range(0, len(at), BLOCK):
                        one = at[lo : lo + BLOCK]
                        text = _strings(*gathered(data, start[one], stop[one + size - 1]))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("lang").take(pa.array(row[one])), text, pa.array(seen[row[one]])], names=["lang", "phrase", "seen"]
                        )

    rows = chunks.mapInArrow(run, "lang string, phrase string, seen long")
    return rows.groupBy("lang", "phrase").agg(F.sum("seen").alias("f")).where(F.col("f") >= mining.fewest)


def frequent_phrases(chunks: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, phrase, f) of every phrase of one to `most_words` words seen at least `fewest` times."""
    word = F.explode(F.slice(F.split("chunk", " "), F.lit(1), F.col("owned")))
    ones = settled(chunks.select("lang", word.alias("phrase"), "seen").groupBy("lang", "phrase").agg(F.sum("seen").alias("f")).where(F.col("f") >= mining.fewest))
    twos = settled(phrases(chunks, ones, 1, range(2, 3), mining))
    more = settled(phrases(chunks, twos, 2, range(3, mining.most_words + 1), mining))
    return ones.unionByName(twos).unionByName(more)


def ranked(found: DataFrame, totals: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from frequent phrases (lang, phrase, f) and words per lang (lang, n).

    Products of two counts are decimals of up to 37 digits, so scores are exact.
    """
    split = found.withColumn("w", F.split("phrase", " "))
    candidates = split.where(F.size("w") > 1)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    # Whatever lies in a longer phrase of the same count also lies in one that is longer by one word.
    longer = candidates.where(F.size("w") > 2).select(
        "lang", "f", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase")
    )
    longest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("in_longer"))
    k = F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    cuts = candidates.join(longest.hint("merge"), ["lang", "phrase"], "left").where("in_longer is null or in_longer < f")
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "w", k.alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("before"), part(F.col("k") + 1, F.size("w")).alias("after")
    )
    counts = found.select("lang", "phrase", "f")
    cuts = cuts.join(counts.toDF("lang", "before", "l").hint("merge"), ["lang", "before"]).join(counts.toDF("lang", "after", "r").hint("merge"), ["lang", "after"])
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(totals.hint("merge"), "lang").withColumn("by", (1000 * F.col("a")).cast("decimal(18,0)") * exact("n")).withColumn("lr", exact("l") * exact("r"))
    scored = scored.withColumn("score", F.expr("cast(`by` div lr as long)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    listed = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score").withColumn("rank", F.row_number().over(order))
    return listed.where(F.col("rank") <= mining.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """The strongest phrases of each language of `docs` (lang, text)."""
    with brief_shuffles(docs.sparkSession):
        chunks = dictionary(docs, mining)
        totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("seen")).alias("n"))
        return ranked(settled(frequent_phrases(chunks, mining)), totals, mining)
