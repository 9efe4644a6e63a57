"""Quality by a sparse rule ensemble: tree paths as conjunctive rules, lasso logistic weights, Spark column expressions.

Statistics of the whole text are computed once per document. Shallow trees over them give rules (the conditions on the
way to every node); a lasso logistic regression over the rules' indicators leaves few with a weight; the weighted rules
become one column expression, which scores every document inside generated code.

Defined results: null and empty texts have all statistics 0 and are scored by the same rules; repeated rows score
alike; without labelled rows of both classes the score is the one class seen, or 0; extra columns are not returned; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.llm import labelled, wordhash
from limnoscope.llm.rows import settled

STATISTICS = (
    "n_words", "chars_per_word", "upper_share", "digit_share", "symbol_share", "bar_share", "bang_share", "stop_share",
    "line_words", "distinct_words", "repeated_words", "doubled_words", "common_word_share", "capital_words",
)


@dataclass(frozen=True)
class RuleFit:
    trees: int = 24
    depth: int = 3
    lasso: float = 0.0005
    #: Labelled documents to learn from, in hash order.
    max_rows: int = 24_000
    seed: int = 17


def _per_text(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text, one row per text, in the order of STATISTICS."""
    n = len(offsets) - 1
    held = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]).astype(float)
    chosen = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    h, start, end, first = wordhash.word_hashes(data, offsets, wordhash.SPACED)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    # Order by text and hash: runs of equal words are neighbours.
    def runs(keys, docs):
        order = np.lexsort((keys, docs))
        k, d = keys[order], docs[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        length = np.diff(np.append(np.flatnonzero(new), len(k)))
        return d[new], length

    d1, c1 = runs(h, doc)
    g, at = wordhash.grams(h, first, 3)
    d3, c3 = runs(g, doc[at])
    most = np.zeros(n)
    np.maximum.at(most, d1, c1)
    twin = np.zeros(len(h), bool)
    if len(h) > 1:
        twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    capital = (data[start] >= 65) & (data[start] <= 90) if len(h) else np.zeros(0, bool)
    upper = chosen(bytes(range(65, 91)))
    return np.column_stack(
        [
            words, np.bincount(doc, weights=(end - start), minlength=n) / some, held(upper) / size, held(chosen(b"0123456789")) / size,
            held(chosen(b"#*$%&<>{}[]\\^~=+_@")) / size, held(chosen(b"|")) / size, held(chosen(b"!?")) / size, held(chosen(b".,;:")) / size,
            words / (held(chosen(b"\n")) + 1), np.bincount(d1, minlength=n) / some,
            np.bincount(d3, weights=np.where(c3 > 1, c3, 0), minlength=n) / some, np.bincount(doc, weights=twin, minlength=n) / some,
            most / some, np.bincount(doc, weights=capital, minlength=n) / some,
        ]
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double per statistic) per row of `docs` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, len(STATISTICS)))
            for at, end, data, offsets in wordhash.slices(batch.column("text")):
                out[at:end] = _per_text(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in out.T)], names=["doc_id", *STATISTICS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, at most (else over), threshold


def tree_rules(trees) -> list[tuple[Condition, ...]]:
    """The path to every node below the root, as the conditions that hold there; equal rules once."""
    found: dict[tuple[Condition, ...], None] = {}
    for tree in trees:
        todo = [(tree._call_java("rootNode"), ())]
        while todo:
            node, path = todo.pop()
            if path:
                found[tuple(sorted(path))] = None
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                at, cut = split.featureIndex(), float(split.threshold())
                todo += [(node.leftChild(), (*path, (at, True, cut))), (node.rightChild(), (*path, (at, False, cut)))]
    return list(found)


def rule_column(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for at, low, cut in rule:
        out = out & ((F.col(STATISTICS[at]) <= cut) if low else (F.col(STATISTICS[at]) > cut))
    return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", params: RuleFit = RuleFit()) -> Model:
    """Rules with a weight, learned from a bounded sample of labelled rows outside the hold-out."""
    picked = labelled.sample(labels, label, params.max_rows)
    # At most max_rows ids of 16 bytes. The joined sample is dealt to a few tasks by a shuffle of its own, so the
    # statistics before it are read by as many tasks as they have parts.
    train = settled(stats.join(F.broadcast(picked), "doc_id").repartition(8, "doc_id"))
    classes = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return Model(40.0 if 1 in classes else -40.0, ())
    vector = VectorAssembler(inputCols=list(STATISTICS), outputCol="stats").transform(train).select("stats", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(
        featuresCol="stats", labelCol="label", numTrees=params.trees, maxDepth=params.depth, maxBins=64, seed=params.seed, featureSubsetStrategy="onethird"
    ).fit(vector)
    rules = tree_rules(forest.trees)
    if not rules:
        share = classes.get(1, 0) / sum(classes.values())
        return Model(float(np.log(share / (1 - share))), ())
    flags = [rule_column(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)]
    shown = train.select(F.col("label").cast("double").alias("label"), *flags)
    shown = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(shown).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=params.lasso, maxIter=60, standardization=True).fit(shown)
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0.0))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", params: RuleFit = RuleFit()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; predicted is 1 from a score of 0.3."""
    stats = settled(statistics(docs))
    scored = stats.select("doc_id", fit(stats, labels, label, params).score().alias("score"))
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
