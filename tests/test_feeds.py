import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnoscope.operators import sensors, tables
from limnoscope.operators.quantiles import grouped_distribution
from limnoscope.schemas import SENSOR
from limnoscope.streaming import sensor_stream

T0 = dt.datetime(2024, 1, 1)


def feed(spark, rows):
    """rows: (hour, phycocyanin, chlorophyll)"""
    full = [(T0 + dt.timedelta(hours=h), "R", -1.0, 41.0, chl, pc, None, None, None, 5.0) for h, pc, chl in rows]
    return spark.createDataFrame(full, SENSOR)


def test_repeated_rows(spark):
    rows = feed(spark, [(0, 1.0, 9.0), (0, 1.0, 8.0), (0, None, 1.0), (0, None, 2.0), (0, 2.0, 1.0)])
    numbered = rows.coalesce(1).withColumn("ingest_id", F.monotonically_increasing_id())
    once = sensors.drop_repeated(numbered)
    assert sorted((r["phycocyanin"] or -1, r["chlorophyll"]) for r in once.collect()) == [(-1, 1.0), (1.0, 9.0), (2.0, 1.0)]
    twice = sensors.drop_repeated(once)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_headers_by_substring(spark):
    raw = spark.createDataFrame([(1, 2, 3)], "`Fecha-hora` int, `PC_IVF ug` int, other int")
    got = sensors.rename_by_substring(raw, {"fecha": "ts", "pc_ivf": "phycocyanin"})
    assert got.columns == ["ts", "phycocyanin"]


@pytest.mark.parametrize(
    "start, end, cut, want",
    [
        ("2024-03-13", "2024-06-30", None, [("2024-03-13", "2024-06-10"), ("2024-06-11", "2024-06-30")]),
        ("2024-01-01", "2024-03-30", ("2024-02-01", "2024-02-10"), [("2024-01-01", "2024-01-31"), ("2024-02-11", "2024-03-30")]),
        ("2024-01-01", "2024-03-30", ("2023-12-01", "2024-05-01"), []),
        ("2024-01-01", "2024-03-30", ("2024-03-30", "2024-05-01"), [("2024-01-01", "2024-03-29")]),
        ("2024-01-01", "2024-03-30", ("2024-05-01", "2024-05-02"), [("2024-01-01", "2024-03-30")]),
    ],
)
def test_periods(spark, start, end, cut, want):
    got = sensors.periods(spark, start, end, exclude=cut)
    assert sorted((str(r[0]), str(r[1])) for r in got.collect()) == want


def test_merge_and_recent(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ts int, a double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "ts int, b double")
    assert sorted(map(tuple, sensors.merge_sensors(a, b, ["ts"]).collect())) == [(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)]
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-31')) as date")
    assert sensors.recent(days, F.lit("2024-01-20").cast("date")).count() == 15
    assert days.select(sensors.previous_day(F.col("date")).alias("d")).first()["d"] == dt.date(2023, 12, 31)


def test_table_changes(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, name string, v double")
    changes = spark.createDataFrame([(1, None), (9, 9.0)], "id int, v double")
    updated = tables.update_rows(base, changes, "id")
    assert sorted(map(tuple, updated.collect())) == [(1, "a", None), (2, "b", 2.0), (3, "c", 3.0)]
    assert tables.delete_rows(base, changes.select("id"), "id").count() == 2
    assert tables.insert_rows(base, spark.createDataFrame([(7,)], "id int")).where("id = 7 and v is null").count() == 1


def test_paging(spark):
    base = spark.range(100).selectExpr("id", "concat('Name ', id) as name", "id % 2 = 0 as even")
    rows, total = tables.page(base, 5, 10, "NAME 1", ["name"])
    assert total.first()["total"] == 11 and [r["id"] for r in rows.collect()] == [1]
    rows, total = tables.page(base, 5, 10)
    assert total.first()["total"] == 100 and [r["id"] for r in rows.collect()] == [89, 88, 87, 86, 85]
    assert tables.page(base, 5, 0, "true", ["even", "id"])[1].first()["total"] == 50


def test_profile(spark):
    df = spark.createDataFrame([(1, "2.5", True, T0), (2, "x", None, None)], "i int, s string, b boolean, t timestamp")
    got = {r["column_name"]: r for r in tables.column_profile(df).collect()}
    assert [got[c]["type_class"] for c in "isbt"] == ["number", "text", "bool", "date"]
    assert [got[c]["n_present"] for c in "isbt"] == [2, 2, 1, 1] and got["s"]["n_numeric"] == 1
    assert {r["column_name"] for r in tables.numeric_candidates(df).collect()} == {"i", "s"}


def land(path, parts):
    """Write each part as its own file, oldest first."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)


def test_stream_dedupe_equals_batch(spark, tmp_path):
    batches = [[(h, float(h % 3), 1.0) for h in range(s, s + 10)] for s in (0, 5, 10)]
    landed = str(tmp_path / "in")
    land(landed, [feed(spark, b) for b in batches])
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        stream = sensor_stream.read_feed(spark, landed, files_per_trigger=1)
        sensor_stream.append_to(sensor_stream.drop_repeated(stream), out, marks, ["reservoir_code"]).awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 20
    land(landed, [feed(spark, [(19, 1.0, 1.0), (25, 4.0, 1.0)])])
    assert run() == 21  # the checkpoint remembers what came before


def test_stream_dedupe_of_a_hot_row(spark, tmp_path):
    landed = str(tmp_path / "in")
    copies = feed(spark, [(1, 1.0, None)] * 300 + [(h, 2.0, None) for h in range(10)])
    numbered = copies.coalesce(1).withColumn("arrival", F.monotonically_increasing_id())
    land(landed, [numbered, numbered.where("arrival < 50")])
    stream = sensor_stream.read_feed(spark, landed, numbered.schema, files_per_trigger=1)
    once = sensor_stream.drop_repeated(stream, salt_from=["arrival"])
    sensor_stream.append_to(once, str(tmp_path / "out"), str(tmp_path / "m")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_stream_daily_statistics_equal_batch(spark, tmp_path):
    rows = [(h, float((h * 7) % 11), None) for h in range(0, 60)]
    landed = str(tmp_path / "in")
    land(landed, [feed(spark, rows[i : i + 20]) for i in (0, 20, 40)])
    stream = sensor_stream.read_feed(spark, landed, files_per_trigger=1)
    counts = sensor_stream.daily_value_counts(stream, ["reservoir_code"], "phycocyanin", ts="date_time")
    sensor_stream.keep_current(counts, str(tmp_path / "c"), str(tmp_path / "m")).awaitTermination()
    got = sensor_stream.current_daily_statistics(spark, str(tmp_path / "c"), ["reservoir_code"]).orderBy("date").collect()
    batch = grouped_distribution(
        feed(spark, rows).withColumn("date", F.to_date("date_time")), ["date", "reservoir_code"], "phycocyanin", {"value_median": 0.5}
    ).orderBy("date").collect()
    pick = lambda rs: [(r["date"], r["n_obs"], r["value_mean"], r["value_median"], r["value_min"], r["value_max"]) for r in rs]
    assert pick(got) == pick(batch)


def test_late_rows_are_dropped(spark, tmp_path):
    landed = str(tmp_path / "in")
    land(landed, [feed(spark, [(0, 1.0, None), (500, 1.0, None)])])
    run = lambda: sensor_stream.keep_current(
        sensor_stream.daily_value_counts(
            sensor_stream.read_feed(spark, landed), ["reservoir_code"], "phycocyanin", ts="date_time"
        ),
        str(tmp_path / "c"), str(tmp_path / "m"),
    ).awaitTermination()
    run()
    land(landed, [feed(spark, [(1, 1.0, None), (501, 1.0, None)])])
    run()
    got = sensor_stream.current_daily_statistics(spark, str(tmp_path / "c"), ["reservoir_code"]).orderBy("date").collect()
    assert [r["n_obs"] for r in got] == [1, 2]
