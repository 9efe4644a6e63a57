"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage by block-max WAND.

Items are short texts; their index holds, per word, the items with their BM25 impact as a share of the item's score for
itself, and the largest impact of every block of items. Every document is cut into passages of twice the longest item's
words that overlap by half, so an occurrence of an item lies whole in one passage. A passage's distinct words are the
query. Bounds from block maxima rule out most passages and blocks at once for a whole batch; the blocks left are searched
with block-max WAND, and all items at or above the threshold are retrieved, without a limit. A retrieved item is a leak
if the passage holds 0.8 of its five-word shingles, or 0.8 of those of both its question and its answer.

Without a question and an answer column, an item's last sentence is the answer and the rest the question. Parts with
fewer words than a shingle are looked up whole.

Document frequencies, the mean length and the longest item are those of the whole benchmark, found by Spark. Only the
postings are cut: an index holds a block of items of bounded size, is sent to all tasks and built once per worker, and a
larger benchmark is met block after block. Scores and leaks are the same at every block size.

Defined results: null and blank texts hold no leak; null and blank items are never found; repeated rows are judged one
by one, repeated items each count; extra columns stay (one named like `into` is replaced); an empty table on either
side gives documents without leaks. Whole texts are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from limnoscope.llm import wordhash
from limnoscope.llm.rows import free_name, settled
from limnoscope.llm.wordhash import U

LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,overlap:double>>"


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's own score from which it is retrieved.
    threshold: float = 0.6
    overlap: float = 0.8
    shingle: int = 5
    block_items: int = 8
    #: Items and characters of one index, and so of one broadcast, on average.
    index_items: int = 4_000
    index_chars: int = 1_600_000


@dataclass(frozen=True)
class Corpus:
    """What BM25 asks of the whole benchmark; `often` holds the items of each word."""

    items: int
    mean_words: float
    longest: int
    often: dict[int, int]


def _item_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return wordhash.word_hashes(data, np.array([0, len(data)]), wordhash.ALPHANUMERIC)[0]


def _shingles(h: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Distinct shingle hashes and their words; a shorter part is one shingle of its own length."""
    size = min(size, len(h))
    if size == 0:
        return np.zeros(0, U), 0
    return np.unique(wordhash.grams(h, np.array([0, len(h)]), size)[0]), size


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item without columns for them: the last sentence is the answer."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)|\n", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def corpus_of(words: list[np.ndarray]) -> Corpus:
    """The figures of a benchmark that is one block."""
    often = np.unique(np.concatenate([np.unique(h) for h in words]), return_counts=True) if words else ([], [])
    return Corpus(len(words), sum(map(len, words)) / max(len(words), 1), max(map(len, words), default=1), {int(t): int(n) for t, n in zip(*often)})


class Index:
    """Postings by word, impacts, block maxima and the shingles to verify with, for a block of the benchmark's items."""

    def __init__(self, items: list[tuple[int, str, str, str]], params: Bm25 = Bm25(), corpus: Corpus | None = None):
        self.params = params
        self.ids: list[int] = []
        words, self.parts = [], []
        for item_id, text, question, answer in items:
            h = _item_words(text)
            if len(h):
                self.ids.append(item_id)
                words.append(h)
                self.parts.append([_shingles(x, params.shingle) for x in (h, _item_words(question), _item_words(answer))])
        n = len(words)
        corpus = corpus or corpus_of(words)
        self.longest = corpus.longest
        self.terms = np.unique(np.concatenate(words)) if n else np.zeros(0, U)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, h in enumerate(words):
            for term, tf in zip(*np.unique(np.searchsorted(self.terms, h), return_counts=True)):
                found[int(term)].append((k, int(tf)))
        own = np.zeros(n)
        raw = {}
        # Words in the order of their hashes, so an item's sum is the same in every block.
        for t in range(len(self.terms)):
            often = corpus.often[int(self.terms[t])]
            idf = math.log(1 + (corpus.items - often + 0.5) / (often + 0.5))
            raw[t] = [(k, idf * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * len(words[k]) / corpus.mean_words))) for k, tf in found[t]]
            for k, w in raw[t]:
                own[k] += w
        # Items in the order of their ids; blocks are runs of items.
        self.blocks = (n + params.block_items - 1) // params.block_items
        self.postings = [[(k, w / own[k]) for k, w in raw[t]] for t in range(len(self.terms))]
        self.block_max = np.zeros((len(self.terms), max(1, self.blocks)), dtype=np.float32)
        for t, posted in enumerate(self.postings):
            for k, w in posted:
                self.block_max[t, k // params.block_items] = max(self.block_max[t, k // params.block_items], w * (1 + 1e-6))
        self.top = self.block_max.max(axis=1) if n else np.zeros(0, np.float32)
        # First look: 20 bits of the hash say which words can be in the index.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.terms >> U(44)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that the index knows, and their terms."""
        at = np.flatnonzero(self.maybe[(h >> U(44)).astype(np.int64)])
        term = np.searchsorted(self.terms, h[at])
        ok = self.terms[np.minimum(term, len(self.terms) - 1)] == h[at]
        return at[ok], term[ok]

    def wand(self, terms: np.ndarray, allowed: np.ndarray) -> list[tuple[int, float]]:
        """All items at or above the threshold by block-max WAND; `allowed` blocks are those whose bound reaches it."""
        need, size = self.params.threshold, self.params.block_items
        lists = [(self.postings[t], float(self.top[t]), t) for t in terms]
        cursor = [0] * len(lists)
        out, end = [], len(self.ids)

        def skip(k: int, item: int) -> None:
            posted = lists[k][0]
            while cursor[k] < len(posted) and posted[cursor[k]][0] < item:
                cursor[k] += 1

        current = lambda k: lists[k][0][cursor[k]][0] if cursor[k] < len(lists[k][0]) else end
        item = 0
        while True:
            order = sorted((current(k), k) for k in range(len(lists)))
            bound, pivot = 0.0, None
            for place, (at, k) in enumerate(order):
                if at >= end:
                    break
                bound += lists[k][1]
                if bound >= need:
                    pivot = place
                    break
            if pivot is None:
                return out
            item = order[pivot][0]
            block = item // size
            # Lists whose cursor stands at or before the pivot can add to it.
            reach = [k for at, k in order if at <= item]
            if not allowed[block] or sum(float(self.block_max[lists[k][2], block]) for k in reach) < need:
                # No item of this block, up to the next list's cursor, can reach the threshold.
                later = [at for at, _ in order if at > item]
                target = (block + 1) * size if not allowed[block] else min([(block + 1) * size, *later])
                for k in reach:
                    skip(k, target)
                continue
            for k in reach:
                skip(k, item)
            score = sum(lists[k][0][cursor[k]][1] for k in sorted(reach) if current(k) == item)
            if score >= need:
                out.append((item, score))
            for k in reach:
                skip(k, item + 1)

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end word) of every passage that retrieves an item."""
        step = self.longest
        count = np.diff(first)
        # Passages start at every multiple of the longest item; the last one of a text may be short.
        passages = np.maximum(1, -(-(count - step) // step)) * (count > 0)
        begin = np.concatenate([[0], np.cumsum(passages)])
        at, term = self.lookup(h)
        if not len(at):
            return []
        text = np.searchsorted(first, at, side="right") - 1
        inner = at - first[text]
        late = np.minimum(inner // step, passages[text] - 1)
        early = np.maximum(inner // step - 1, 0)
        early = np.minimum(early, late)
        both = late > early
        key = np.concatenate([begin[text] + late, (begin[text] + early)[both]]) * len(self.terms) + np.concatenate([term, term[both]])
        key = np.unique(key)
        passage, term = key // len(self.terms), key % len(self.terms)
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        total = np.add.reduceat(self.top[term], starts)
        stops = np.append(starts[1:], len(passage))
        live = np.flatnonzero(total >= self.params.threshold)
        out = []
        for some in np.array_split(live, max(1, len(live) // 4096)):
            if not len(some):
                continue
            picked = np.concatenate([np.arange(starts[k], stops[k]) for k in some])
            edges = np.concatenate([[0], np.cumsum(stops[some] - starts[some])[:-1]])
            bounds = np.add.reduceat(self.block_max[term[picked]], edges, axis=0)
            for k, bound in zip(some, bounds):
                allowed = bound >= self.params.threshold
                if not allowed.any():
                    continue
                p = passage[starts[k]]
                t = int(np.searchsorted(begin, p, side="right")) - 1
                a = int(first[t] + (p - begin[t]) * step)
                b = int(min(first[t + 1], a + 2 * step))
                # Only words that can add to an allowed block take part.
                mine = term[starts[k] : stops[k]]
                mine = mine[(self.block_max[mine][:, allowed] > 0).any(axis=1)]
                out += [(t, item, score, a, b) for item, score in self.wand(mine, allowed)]
        return out

    def verify(self, h: np.ndarray, item: int) -> tuple[float, float, float]:
        """Shares of the item's shingles, its question's and its answer's that the passage holds; an empty part is whole."""
        out = []
        for shingles, size in self.parts[item]:
            if not size:
                out.append(1.0)
                continue
            held = wordhash.grams(h, np.array([0, len(h)]), size)[0]
            out.append(float(np.isin(shingles, held).mean()))
        return out[0], out[1], out[2]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, question, answer, n_words, terms) of every item with a word."""
    cols = {c.lower() for c in benchmark.columns}
    parts = ["question", "answer"] if {"question", "answer"} <= cols else []
    whole = F.col("text") if "text" in cols else F.concat_ws("\n", "question", "answer")
    given = [F.col(p).cast("string").alias(p) for p in parts] or [F.lit(None).cast("string").alias(p) for p in ("question", "answer")]
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole.cast("string").alias("text"), *given).where("text is not null")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                question, answer = (r["question"] or "", r["answer"] or "") if parts else split_item(r["text"])
                h = _item_words(r["text"])
                if len(h):
                    out.append((r["item_id"], r["text"], question, answer, len(h), np.unique(h).view(np.int64)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "text", "question", "answer", "n_words", "terms"])

    return rows.mapInArrow(run, "item_id long, text string, question string, answer string, n_words long, terms array<long>")


def _blocks(benchmark: DataFrame, params: Bm25) -> Iterator[tuple[list[tuple[int, str, str, str]], Corpus]]:
    """Items block by block, each with the figures of the whole benchmark; the driver holds one block at a time."""
    items = settled(_items(benchmark))
    whole = items.agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest"), F.sum(F.length("text")).alias("chars")).first()
    if not whole.n:
        return
    count = max(1, math.ceil(whole.n / params.index_items), math.ceil(whole.chars / params.index_chars))
    # Equal items fall into one block; a block's words are its own, their counts the benchmark's.
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))
    often = settled(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    for block in range(count):
        mine = placed.where(F.col("block") == block)
        rows = mine.select("item_id", "text", "question", "answer").orderBy("item_id", "text").collect()
        if rows:
            known = mine.select(F.explode("terms").alias("term")).distinct().join(often, "term").collect()
            counts = {r.term % (1 << 64): r.n for r in known}
            yield [tuple(r) for r in rows], Corpus(whole.n, whole.words / whole.n, whole.longest, counts)


def flagged(docs: DataFrame, benchmark: DataFrame, params: Bm25 = Bm25(), column: str = "text", into: str = "leaks") -> DataFrame:
    """`docs` with `into`: the items found in the column's whole text, each with its best passage."""
    out = docs.drop(into).withColumn(into, F.expr(f"cast(array() as {LEAKS})"))
    for items, corpus in _blocks(benchmark, params):
        out = _with_block(out, items, corpus, params, column, into)
    return out


_built: dict[str, Index] = {}


def _index(name: str, sent, params: Bm25) -> Index:
    """The index of one broadcast, built once per worker process; only the last one is kept."""
    if name not in _built:
        _built.clear()
        items, corpus = sent.value
        _built[name] = Index(items, params, corpus)
    return _built[name]


def _with_block(docs: DataFrame, items: list, corpus: Corpus, params: Bm25, column: str, into: str) -> DataFrame:
    # Some index_items items and index_chars characters.
    sent = docs.sparkSession.sparkContext.broadcast((items, corpus))
    name = uuid.uuid4().hex
    held = free_name(docs, "found")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("overlap", pa.float64())]))

    def run(batches):
        index = _index(name, sent, params)
        for batch in batches:
            leaks: list[dict] = [{} for _ in range(batch.num_rows)]
            for at, _, data, offsets in wordhash.slices(batch.column(column)):
                h, _, _, first = wordhash.word_hashes(data, offsets, wordhash.ALPHANUMERIC)
                for text, item, score, a, b in index.search(h, first) if index.ids else []:
                    whole, question, answer = index.verify(h[a:b], item)
                    if whole >= params.overlap or (question >= params.overlap and answer >= params.overlap):
                        best = leaks[at + text].get(item)
                        if best is None or (whole, score) > (best["overlap"], best["score"]):
                            leaks[at + text][item] = {"item_id": index.ids[item], "score": score, "question_overlap": question, "answer_overlap": answer, "overlap": whole}
            found = pa.array([[x[k] for k in sorted(x)] for x in leaks], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, held])

    schema = StructType([*docs.schema.fields, StructField(held, docs.schema[into].dataType)])
    return docs.mapInArrow(run, schema).withColumn(into, F.concat(into, held)).drop(held)


def leaks(docs: DataFrame, benchmark: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap), one row per leak."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return flagged(rows, benchmark, params).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
