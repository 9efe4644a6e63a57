"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed words, word pairs and pairs with one word between. Every coordinate has its own
learning rate, and the L1 term leaves most weights at exactly 0, so the model is a small table sent to all tasks
(2**bits weights at most). Shards of the labelled sample are trained side by side; after each round the coordinates'
states are averaged and the next round starts from them.

Defined results: null and empty texts score by the intercept alone; repeated rows score alike; without labelled rows
every score is 0; extra columns are not returned; an empty table gives no rows. Whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limnoscope.llm import labelled, wordhash
from limnoscope.llm.rows import settled


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.0
    rounds: int = 8
    shards: int = 4
    #: Labelled documents to learn from, in hash order.
    max_rows: int = 24_000


def _features(texts, bits: int):
    """(first row, rows, document of each feature, bucket of each feature), features as often as they occur."""
    for at, end, data, offsets in wordhash.slices(texts):
        h, _, _, first = wordhash.word_hashes(data, offsets, wordhash.ALPHANUMERIC)
        parts = [(h, np.arange(len(h))), wordhash.grams(h, first, 2), wordhash.grams(h, first, 2, skip=1)]
        doc = np.repeat(np.arange(end - at), np.diff(first))
        shift = wordhash.U(64 - bits)
        yield at, end - at, np.concatenate([doc[w] for _, w in parts]), np.concatenate([(g >> shift).astype(np.int64) for g, _ in parts])


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    w[np.abs(z) <= p.l1] = 0.0
    return w


def _train_shard(rows: pd.DataFrame, z0: np.ndarray, n0: np.ndarray, p: Ftrl) -> pd.DataFrame:
    """One pass over a shard's documents; the last coordinate is the intercept, free of L1."""
    z, n, bias = z0.copy(), n0.copy(), 1 << p.bits
    touched = np.zeros(bias + 1, dtype=bool)
    for label, packed in zip(rows["label"], rows["features"]):
        at = np.append(np.frombuffer(packed, dtype=np.int32), bias)
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        w[np.abs(zi) <= p.l1] = 0.0
        w[-1] = -zi[-1] / ((p.beta + np.sqrt(ni[-1])) / p.alpha)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
        z[at] = zi + g - sigma * w
        n[at] = ni + g * g
        touched[at] = True
    at = np.flatnonzero(touched)
    return pd.DataFrame({"at": at, "z": z[at] - z0[at], "n": n[at] - n0[at]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: Ftrl = Ftrl()) -> np.ndarray | None:
    """Weights per bucket, the intercept last; None without labelled rows."""
    p, size = params, (1 << params.bits) + 1
    picked = labelled.sample(labels, label, p.max_rows)

    def pack(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for at, rows, doc, bucket in _features(batch.column("text"), p.bits):
                key = np.unique(doc * (1 << p.bits) + bucket)
                edges = np.searchsorted(key, np.arange(rows + 1) << p.bits)
                for k in range(rows):
                    out[at + k] = (key[edges[k] : edges[k + 1]] & ((1 << p.bits) - 1)).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "features"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_rows ids of 16 bytes.
    known = known.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
    rows = settled(
        known.mapInArrow(pack, "doc_id long, label int, features binary")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(p.shards)).cast("int"))
        .repartition(p.shards, "shard")
    )
    if rows.isEmpty():
        return None
    spark, z, n = docs.sparkSession, np.zeros(size), np.zeros(size)
    for turn in range(p.rounds):
        state = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def train(parts):
            z0, n0 = (x.astype(np.float64) for x in state.value)
            held = [part for part in parts if len(part)]
            if not held:
                return
            # A task's share of the bounded sample, dealt by shard; each round has an order of its own.
            for _, part in pd.concat(held).sort_values("doc_id", kind="stable").groupby("shard"):
                order = np.argsort(pd.util.hash_array(part["doc_id"].to_numpy() + turn), kind="stable")
                yield _train_shard(part.iloc[order], z0, n0, p)

        steps = rows.mapInPandas(train, "at long, z double, n double")
        # Shards' steps are averaged per coordinate; coordinates no shard touched stay.
        moved = steps.groupBy("at").agg((F.sum("z") / p.shards).alias("z"), (F.sum("n") / p.shards).alias("n")).toPandas()
        z[moved["at"]] += moved["z"]
        n[moved["at"]] += moved["n"]
        state.unpersist()
    w = _weights(z, n, p)
    w[-1] = -z[-1] / ((p.beta + np.sqrt(n[-1])) / p.alpha)
    return w


def score(docs: DataFrame, weights: np.ndarray | None, bits: int = Ftrl.bits) -> DataFrame:
    """(doc_id, score) per row of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if weights is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    # The L1 term leaves few weights: the model travels as (bucket, weight) pairs.
    at = np.flatnonzero(weights[:-1])
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at].astype(np.float32), float(weights[-1])))

    def run(batches):
        at, w, bias = model.value
        table = np.zeros(1 << bits, dtype=np.float64)
        table[at] = w
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for row, rows, doc, bucket in _features(batch.column("text"), bits):
                weighty = np.flatnonzero(table[bucket])
                key = np.unique((doc[weighty] << bits) + bucket[weighty])
                total[row : row + rows] += np.bincount(key >> bits, weights=table[key & ((1 << bits) - 1)], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"]
            )

    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", params: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; predicted is 1 from a score of 0.5."""
    scored = score(docs, fit(docs, labels, label, params), params.bits)
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
