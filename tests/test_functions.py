import math

import pytest
from pyspark.sql import functions as F

from limnoscope.functions import geometry, masks, numeric, spectral, temporal, text
from limnoscope.operators.dimensions import allowed_indices, find_reservoir, scl_dimension

BANDS = dict(b3=700.0, b4=500.0, b5=900.0, b6=800.0, b7=650.0, b8a=400.0)


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_index_formulas(spark):
    b3, b4, b5, b6, b7, b8a = (v / 10000 for v in BANDS.values())
    ndci = (b5 - b4) / (b5 + b4)
    expected = {
        "MCI": b5 - b4 - (b6 - b4) * 40 / 75,
        "PCI_B5/B4": b5 / b4,
        "NDCI_ind": ndci,
        "PC_Val_cal": 100 / (1 + math.exp(-4.6755 * (b5 / b4 - 1.9895))),
        "Chla_Val_cal": 450 / (1 + math.exp(-7.14 * (ndci - 0.46))),
        "PC_Bellus_cal": 16957 * (b6 - (0.96 * b8a + 0.51 * (b3 - b8a))) + 571,
        "Chla_Bellus_cal": 112.78 * ndci + 10.779,
        "UV_PC_Gral_cal": 24.665 * (b5 / b4) ** 3.4607,
        "R783_R665": b7 / b4,
        "NDRE_740_705": (b6 - b5) / (b6 + b5),
        "TB_783": b7 - b5,
    }
    row = spectral.with_indices(one(spark, scl=6, **BANDS), list(expected)).first()
    for name, want in expected.items():
        assert row[name] == pytest.approx(want, rel=1e-12), name


def test_masked_pixels_stay_null(spark):
    cloudy = spectral.with_indices(one(spark, scl=9, **BANDS), spectral.WATER_QUALITY_NAMES).first()
    assert all(cloudy[n] is None for n in spectral.WATER_QUALITY_NAMES)
    low_cloud = spectral.with_indices(one(spark, scl=7, **BANDS), ["MCI"]).first()
    assert low_cloud["MCI"] is not None
    masked = one(spark, scl=6, **BANDS).withColumn("b4", F.lit(None).cast("double"))
    row = spectral.with_indices(masked, ["Chla_Bellus_cal", "PC_Bellus_cal", "R705_R665"]).first()
    assert row["Chla_Bellus_cal"] is None and row["R705_R665"] is None and row["PC_Bellus_cal"] is not None


def test_clamp_zero_denominator_and_scaling(spark):
    low = one(spark, scl=6, **{**BANDS, "b5": 10.0})
    assert spectral.with_indices(low, ["Chla_Bellus_cal"]).first()["Chla_Bellus_cal"] == 0.0
    zero = one(spark, scl=6, **{**BANDS, "b4": 0.0})
    assert spectral.with_indices(zero, ["PCI_B5/B4"]).first()["PCI_B5/B4"] is None
    doubled = one(spark, scl=6, **{k: v * 2 for k, v in BANDS.items()})
    for name in ("NDCI_ind", "PCI_B5/B4", "PC_Val_cal"):
        a = spectral.with_indices(one(spark, scl=6, **BANDS), [name]).first()[name]
        assert spectral.with_indices(doubled, [name]).first()[name] == pytest.approx(a)


def test_unknown_index_and_missing_band(spark):
    with pytest.raises(ValueError, match="unknown"):
        spectral.with_indices(one(spark, scl=6, **BANDS), ["NOPE"])
    with pytest.raises(ValueError, match="b8a"):
        spectral.with_indices(one(spark, scl=6, **BANDS).drop("b8a"), ["PC_Bellus_cal"])


def test_scaled_bands(spark):
    row = spectral.scaled_bands(one(spark, **BANDS), ["b4", "b5"]).first()
    assert (row["b4"], row["b5"], row["b6"]) == (0.05, 0.09, 800.0)


def test_own_index(spark):
    index = spectral.SpectralIndex("own_ratio", ("b3", "b4"), lambda r: F.try_divide(r["b3"], r["b4"]))
    spectral.register(index)
    try:
        assert spectral.with_indices(one(spark, **BANDS), ["own_ratio"]).first()["own_ratio"] == pytest.approx(1.4)
        with pytest.raises(ValueError):
            spectral.register(index)
    finally:
        spectral._registry.pop("own_ratio")


def test_water_rule(spark):
    rows = spark.sql(
        "select * from values (6, date'2017-01-01'), (2, date'2017-01-01'), (2, date'2018-07-01'), (5, date'2018-07-01') t(scl, d)"
    )
    assert [r.w for r in rows.select(masks.is_water(F.col("scl"), F.col("d")).alias("w")).collect()] == [True, False, True, False]


def test_text(spark):
    df = one(spark, n="El  Val", a=" Bellús ", h="Turbidez µ ñandú", t="_pc (µg/L)!", e="((")
    assert value(df, text.name_key(F.col("n"))) == "el__val"
    assert value(df, text.alias_key(F.col("a"))) == "bellus"
    assert value(df, text.strip_accents(F.col("h"))) == "Turbidez  nandu"
    assert value(df, text.calibrated_band_name(F.col("t"))) == "Calibrated_pc__µg_L"
    assert value(df, text.calibrated_band_name(F.col("e"))) == "Calibrated_calibrated"
    assert len(value(one(spark, t="x" * 200), text.calibrated_band_name(F.col("t")))) == 80
    assert value(one(spark, c=" <b>a</b>&nbsp; <i>b</i> "), text.plain_cell(F.col("c"))) == "a b"


def test_time(spark):
    df = one(spark, s="05-03-2024 10:20:30", b="x", d="2024-03-05", t="10:20")
    ts = temporal.lenient_timestamp(F.col("s"))
    assert value(df, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) == "2024-03-05 10:20:30"
    assert value(df, temporal.lenient_timestamp(F.col("b"))) is None
    assert value(df, temporal.display_time(temporal.combined_timestamp(F.col("d"), F.col("t")))) == "05-03-2024 10:20"
    assert value(df, temporal.fractional_hour(ts)) == pytest.approx(10 + 20 / 60 + 30 / 3600)
    millis = temporal.from_epoch_millis(F.lit(1709634030000))
    assert value(df, F.date_format(millis, "yyyy-MM-dd HH:mm:ss")) == "2024-03-05 10:20:30"


def test_numbers(spark):
    df = one(spark, c=" 12,5 ", x="n/a")
    assert value(df, numeric.comma_decimal(F.col("c"))) == 12.5
    assert value(df, numeric.lenient_double(F.col("x"))) is None
    assert value(df, numeric.class_edges(0, 10, 5)) == [0, 2, 4, 6, 8, 10]
    assert value(df, numeric.class_label(F.lit(0.5), F.lit(1.0))) == "0.5–1.0"
    assert value(df, numeric.percent(F.lit(1.0), F.lit(0.0))) == 0.0


def test_geometry_columns(spark):
    ring = F.expr("array(struct(0D x,0D y), struct(4D x,0D y), struct(4D x,2D y), struct(0D x,2D y), struct(0D x,0D y))")
    cx, cy = geometry.ring_centroid(ring)
    df = spark.range(1)
    assert (value(df, cx), value(df, cy)) == (2.0, 1.0)
    assert value(df, geometry.contains(ring, F.lit(1.0), F.lit(1.0)))
    assert not value(df, geometry.contains(ring, F.lit(5.0), F.lit(1.0)))
    far = geometry.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert value(df, far) == pytest.approx(111195, rel=1e-3)


def test_dimensions(spark):
    names = spark.createDataFrame([("EL VAL",), ("Bellus",), ("Otro",)], "name string")
    got = allowed_indices(names).groupBy("name").agg(F.sort_array(F.collect_set("index_name")).alias("i"))
    sizes = {r["name"]: r["i"] for r in got.collect()}
    assert {k: len(v) for k, v in sizes.items()} == {"EL VAL": 6, "Bellus": 6, "Otro": 4}
    assert "PC_Val_cal" in sizes["EL VAL"] and "PC_Bellus_cal" in sizes["Bellus"]
    assert find_reservoir(names, "el val").count() == 1
    assert scl_dimension(spark).count() == 11
