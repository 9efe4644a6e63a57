"""Forests grown by jobs per level against the same trees grown in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnoscope.calibration import forests

GRID = forests.ForestGrid(trees=(3, 7), depths=(None, 1, 3), leaf_rows=(1, 3))


def calibrations(spark, n=26):
    rng, rows = random.Random(3), []
    for reservoir, variable, size in ((1, "a", n), (1, "b", n - 4), (2, "a", 5)):
        for k in range(size):
            x, z = rng.randrange(9) / 4, round(rng.random(), 2)
            part = -1 if k % 5 == 4 else -2 if k == 1 else k % 3
            rows.append((reservoir, variable, f"2024-01-{k + 1:02d}", round(3 * x + (x > 1) * 5 + rng.random(), 3), x, z, part))
    return spark.createDataFrame(rows, "reservoir_id int, variable string, date string, y_true double, x double, z double, part int")


def plain_tree(rows, leaf, level=0, limit=None):
    """Value at each row after at most `limit` levels; rows are (bins, y, weight, learns)."""
    seen = [r for r in rows if r[2] > 0]
    w, s = sum(r[2] for r in seen), sum(r[2] * r[1] for r in seen)
    best = None
    if limit is None or level < limit:
        for p in range(len(rows[0][0])):
            for cut in sorted({r[0][p] for r in seen}):
                left = [r for r in seen if r[0][p] <= cut]
                if len(left) < leaf or len(seen) - len(left) < leaf:
                    continue
                wl, sl = sum(r[2] for r in left), sum(r[2] * r[1] for r in left)
                gain = round(sl * sl / wl + (s - sl) ** 2 / (w - wl) - s * s / w, 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, p, cut)
    if best is None:
        return {id(r): s / w for r in rows}
    _, p, cut = best
    out = {}
    for side in (True, False):
        below = [r for r in rows if (r[0][p] <= cut) == side]
        if below:
            out |= plain_tree(below, leaf, level + 1, limit)
    return out


def test_forests_equal_plain_trees(spark):
    parts = calibrations(spark)
    result = forests.fit_forests(parts, ["x", "z"], GRID)
    group = ["reservoir_id", "variable"]
    rows, edges = forests.binned(parts, ["x", "z"], group, GRID.bins)
    for e in edges.collect():  # few rows: every distinct value ends a bin
        mine = [r for r in parts.collect() if (r.reservoir_id, r.variable) == (e.reservoir_id, e.variable)]
        assert [list(x) for x in e.edges] == [sorted({r.x for r in mine}), sorted({r.z for r in mine})]
    seats = forests._seats(rows, "kfold", group).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(6))))
    drawn = seats.withColumn("w", F.when(F.col("learns"), forests._draws(GRID.seed, F.struct(*group, "fit", "number"), [*group, "date"])).otherwise(F.lit(0))).collect()
    scores = {(s.reservoir_id, s.variable, s.candidate, s.part): s for s in result.scores.collect()}
    assert {k[:2] for k in scores} == {(1, "a"), (1, "b")}  # the third calibration has too few rows
    for key in {k[:2] for k in scores}:
        for fold in range(3):
            trees = {}
            for number in range(7):
                mine = [r for r in drawn if (r.reservoir_id, r.variable, r.fit, r.number) == (*key, fold, number)]
                trees[number] = [(tuple(r.bins), r.y_true, r.w, r.learns, r.date) for r in mine if r.w > 0 or not r.learns]
            for candidate, n_trees, depth, leaf in GRID.candidates():
                guesses = {}
                for number in range(n_trees):
                    values = plain_tree(trees[number], leaf, limit=depth)
                    for r in trees[number]:
                        if not r[3]:
                            guesses.setdefault((r[4], r[1]), []).append(values[id(r)])
                errors = [y - np.mean(g) for (_, y), g in guesses.items()]
                got = scores[(*key, candidate, fold)]
                assert got.n == len(errors) and got.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors)))) and got.mae == pytest.approx(np.mean(np.abs(errors)))


def test_choice_and_sets(spark):
    parts = calibrations(spark)
    result = forests.fit_forests(parts, ["x", "z"], GRID)
    metrics = {(m.reservoir_id, m.variable): m for m in result.metrics.collect()}
    for key, m in metrics.items():
        per = {}
        for s in result.scores.collect():
            if (s.reservoir_id, s.variable) == key:
                per.setdefault(s.candidate, []).append(s.r2)
        best = min(per, key=lambda c: (-np.mean(per[c]), c))
        assert m.candidate == best and m.cv_r2_mean == pytest.approx(np.mean(per[best])) and m.train_r2 > 0.5
    predictions = result.predictions.collect()
    want = {(r.reservoir_id, r.variable, r.date): "test" if r.part == -1 else "train" for r in parts.collect() if r.part >= -1 and (r.reservoir_id, r.variable) in metrics}
    assert {(p.reservoir_id, p.variable, p.date): p.set for p in predictions} == want and len(predictions) == len(want)


def test_time_series_learns_from_the_past_only(spark):
    rows = [(1, "a", f"{p}-{k}", float(100 * p), float(k % 3), 0.0, p) for p in range(3) for k in range(8)]
    parts = spark.createDataFrame(rows, "reservoir_id int, variable string, date string, y_true double, x double, z double, part int")
    grid = forests.ForestGrid(trees=(3,), depths=(2,), leaf_rows=(1,))
    scores = {s.part: s for s in forests.fit_forests(parts, ["x", "z"], grid, scheme="timeseries").scores.collect()}
    assert set(scores) == {1, 2} and scores[1].mae == pytest.approx(100.0) and scores[2].mae > 100.0


def test_no_rows(spark):
    assert forests.fit_forests(calibrations(spark).limit(0), ["x", "z"], GRID).metrics.count() == 0


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def test_deep_trees_of_few_rows_need_no_more_jobs(spark):
    """Each row halves what is left, so trees of 40 rows are far deeper than those of 18."""
    schema, jobs = "reservoir_id int, variable string, date string, y_true double, x double, part int", []
    grid = forests.ForestGrid(trees=(3,), depths=(None,), leaf_rows=(1,))
    for n in (18, 40):
        parts = spark.createDataFrame([(1, "a", f"{k}", float(2**k), float(k), k % 3) for k in range(n)], schema)
        jobs.append(jobs_of(spark, f"forests-{n}", lambda: forests.fit_forests(parts, ["x"], grid).scores.count()))
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("least", (0, 8))
def test_large_and_small_nodes_grow_alike(spark, monkeypatch, least):
    """Down by a job per level to the leaves, or until `least` rows are left, against whole trees in one task."""
    parts = calibrations(spark)
    whole = forests.fit_forests(parts, ["x", "z"], GRID)
    monkeypatch.setattr(forests, "NODE_ROWS", least)
    parted = forests.fit_forests(parts, ["x", "z"], GRID)
    key = ("reservoir_id", "variable", "candidate", "part")
    scores = [{tuple(s[c] for c in key): (s.n, s.r2, s.rmse, s.mae) for s in f.scores.collect()} for f in (whole, parted)]
    assert scores[0].keys() == scores[1].keys() and all(scores[0][k] == pytest.approx(scores[1][k]) for k in scores[0])
    nodes = [{(n.tree, n.node): (n.level, n.predictor, n.cut, pytest.approx(n.value)) for n in f.nodes.collect()} for f in (whole, parted)]
    assert nodes[0] == nodes[1] and len(nodes[0]) == parted.nodes.count() and len({n[0] for n in nodes[0]}) == 2 * 4 * 7 * 2
    predictions = [{(p.reservoir_id, p.variable, p.date): (p.set, pytest.approx(p.y_pred)) for p in f.predictions.collect()} for f in (whole, parted)]
    assert predictions[0] == predictions[1]


@pytest.mark.parametrize("at_once", (1, 4, 100))
def test_no_node_is_cut_between_batches(monkeypatch, at_once):
    monkeypatch.setattr(forests, "TASK_ROWS", at_once)
    tree, node = [1] * 5 + [2] * 7 + [2] * 1 + [3] * 2, [1] * 5 + [4] * 7 + [5] * 1 + [1] * 2
    rows = pa.table({"tree": tree, "node": node, "k": range(15)})
    got = [(t["k"].to_pylist(), r.tolist()) for t, r in forests._whole_nodes(iter(rows.to_batches(max_chunksize=3)))]
    assert [k for ks, _ in got for k in ks] == list(range(15))
    seen = [{(tree[k], node[k]) for k in ks} for ks, _ in got]
    assert all(not a & b for i, a in enumerate(seen) for b in seen[i + 1 :])
    assert all(len(set(r)) == len({(tree[k], node[k]) for k in ks}) and r == sorted(r) for ks, r in got)


def test_gains_round_as_spark_rounds_them(spark):
    gains = [985.7245140625, 985.7245140624999, 985.7245140624982, 0.0000000005, 1.4e-9, 63.0000000005, 62.9999999995, 13467.3123765625, 4000000.1234567885, 2.5e8, 1e30]
    gains += [k / 1024 + 2**-11 * (k % 2) + k * 5e-10 for k in range(1, 400)]
    want = [r[0] for r in spark.createDataFrame([(g,) for g in gains], "g double").select(F.round("g", 9)).collect()]
    assert forests._rounded(np.array(gains)).tolist() == want
