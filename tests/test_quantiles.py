import math

import numpy as np
import pytest

from limnoscope.operators import quantiles

PROBS = {"q1": 0.25, "med": 0.5, "q3": 0.75, "low": 0.0, "top": 1.0}


def groups(spark, data):
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("bound", [quantiles.SMALL_GROUP_ROWS, 0, 1500])
def test_against_numpy(spark, bound):
    rng = np.random.default_rng(1)
    data = {
        "normal": rng.normal(0, 50, 4001), "repeated": rng.integers(0, 4, 1000), "tiny": [3.25],
        "heavy": np.exp(rng.normal(0, 6, 2000)) * rng.choice([-1, 1], 2000), "pair": [1, 2], "zeros": [0, 0, 0, -1],
    }
    got = {r["k"]: r for r in quantiles.grouped_distribution(groups(spark, data), ["k"], "v", PROBS, bound).collect()}
    for k, vs in data.items():
        vs = np.asarray(vs, float)
        assert got[k]["n_obs"] == len(vs)
        assert got[k]["value_mean"] == pytest.approx(vs.mean(), rel=1e-9, abs=1e-9)
        assert (got[k]["value_min"], got[k]["value_max"]) == (vs.min(), vs.max())
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (k, name)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 4.0)], "k string, v double")
    row = quantiles.grouped_distribution(df, ["k"], "v", {"med": 0.5}).first()
    assert (row["n_obs"], row["med"]) == (2, 2.5)


@pytest.mark.parametrize("bound", [quantiles.SMALL_GROUP_ROWS, 0])
def test_from_counts(spark, bound):
    counts = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("b", 2.0, 1)], "k string, _value double, _n long")
    got = {r["k"]: r for r in quantiles.distribution_from_counts(counts, ["k"], {"med": 0.5, "q": 0.75}, bound).collect()}
    assert (got["a"]["n_obs"], got["a"]["value_mean"], got["a"]["med"], got["a"]["q"]) == (5, 2.6, 1.0, 5.0)
    assert (got["b"]["n_obs"], got["b"]["med"]) == (1, 2.0)


def test_fence(spark):
    row = quantiles.iqr_fence(groups(spark, {"a": [1, 2, 3, 4]}), ["k"], "v").first()
    assert (row["q1"], row["q3"], row["low"], row["high"]) == (1.75, 3.25, -0.5, 5.5)


def test_slices_never_decrease(spark):
    """Groups of nearly equal values, of far outliers and of edge values are all cut in order."""
    groups = {
        "narrow": [20.0 + k / 1e7 for k in range(3000)], "wide": [float(k) ** 9 for k in range(-1500, 1500)],
        "outlier": [k / 1e6 for k in range(2000)] + [1e300, -1e300],
        "edges": [-math.inf, -1e300, -5e-324, 0.0, 5e-324, 1e-9, 1.0, 1e300, math.inf], "one": [3.0],
    }
    df = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, _value double, _n long")
    found = {}
    for r in quantiles.with_slices(df, ["g"]).orderBy("g", "_value").collect():
        found.setdefault(r.g, []).append(r["_slice"])
    assert all(s == sorted(s) for s in found.values())
    for g in ("narrow", "wide", "outlier"):
        assert max(found[g].count(x) for x in set(found[g])) <= 12
