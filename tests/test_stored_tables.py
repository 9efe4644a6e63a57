"""Pages, search parts and buckets: the same rows as plain scans, and no more read or written than needed."""

import os

import pytest
from pyspark.sql import functions as F

from limnoscope.operators import matching, stored_tables, tables
from limnoscope.streaming import sensor_stream


def people(spark, n=500):
    return spark.range(n).select(
        (F.col("id") * 7 % 1009).alias("k"), F.concat(F.lit("Name-"), F.col("id") % 37, F.lit(" Ñandú")).alias("name"), F.col("id").alias("v")
    )


def test_pages_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    stored_tables.write_paged(people(spark), path, "k", files=6)
    want = [r.k for r in people(spark).orderBy(F.desc("k")).collect()]
    seen, last = [], None
    while True:
        page = [r.k for r in stored_tables.seek_page(spark, path, "k", 33, last).collect()]
        if not page:
            break
        assert len(page) == 33 or len(seen) + len(page) == len(want)
        seen, last = seen + page, page[-1]
    assert seen == want and stored_tables.total_rows(spark, path).first().total == len(want)
    plan = stored_tables.seek_page(spark, path, "k", 10).inputFiles()
    assert len(plan) < 3  # of six files


def test_pages_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    stored_tables.write_paged(people(spark, 0), path, "k")
    assert stored_tables.seek_page(spark, path, "k", 5).count() == 0 and stored_tables.total_rows(spark, path).first().total == 0


@pytest.mark.parametrize("term", ["name-1", "ÑAND", "-3", "e-%dú", "nothing", "ame-12 ñ", "_ame-7"])
def test_search_finds_what_a_scan_finds(spark, tmp_path, term):
    table = people(spark).withColumn("name", F.when(F.col("v") % 11 != 0, F.col("name")))
    path = str(tmp_path / "parts")
    stored_tables.write_search_parts(table, path, "k", ["name"], files=3)
    got = stored_tables.search_by_parts(table, path, "k", ["name"], term).select("k").collect()
    assert sorted(got) == sorted(tables.search(table, term, ["name"]).select("k").collect())


def test_parts_are_folded_in_their_own_ranges(spark, tmp_path, monkeypatch):
    """No task gathers parts before the rows are dealt out: neither where parts are made nor where they are counted."""
    path, source = str(tmp_path / "parts"), str(tmp_path / "people")
    rows = people(spark).unionByName(people(spark).withColumn("name", F.lit("NAME-1 again"))).unionByName(people(spark, 50))
    rows.unionByName(rows.limit(3).withColumn("k", F.lit(None).cast("long"))).coalesce(1).write.parquet(source)
    table = spark.read.parquet(source)
    stored_tables.write_search_parts(table, path, "k", ["name"], files=3)
    stored = spark.read.parquet(path)
    want = {(r.k, r.name.lower()[i : i + 3]) for r in table.collect() for i in range(len(r.name) - 2)}
    assert stored.count() == len(want) and {(r.k, r.part) for r in stored.collect()} == want
    found = stored_tables.search_by_parts(table, path, "k", ["name"], "name-1")
    assert sorted(r.v for r in found.collect()) == sorted(r.v for r in tables.search(table, "name-1", ["name"]).where("k is not null").collect())
    made = stored_tables.search_parts(table, "k", ["name"])
    monkeypatch.setattr(stored_tables, "FILE_LETTERS", 1_000)
    assert stored_tables.search_parts(table, "k", ["name"]).rdd.getNumPartitions() > 5
    for plan in (made, found):
        lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [k for k, line in enumerate(lines) if "FileScan" in line and (plan is made or "part#" in line)]
        above = [next(line for line in lines[k::-1] if "Exchange" in line or "Aggregate" in line) for k in scans]
        assert above and all("Exchange" in line for line in above)


def stamps(path):
    return {d: [f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")] for d in os.listdir(path) if d.startswith("_bucket=")}


def test_changes_touch_their_buckets_only(spark, tmp_path):
    path, table = str(tmp_path / "b"), people(spark)
    stored_tables.write_buckets(table, path, "k", 16)
    before = stamps(path)
    updates = spark.createDataFrame([(7, "changed"), (14, None)], "k long, name string")
    deletes = spark.createDataFrame([(21,), (123456,)], "k long")
    inserts = spark.createDataFrame([(5_000, "new", 1)], "k long, name string, v long")
    touched = stored_tables.change_buckets(spark, path, "k", 16, updates, deletes, inserts)
    after = stamps(path)
    assert {d for d in after if after[d] != before.get(d)} <= {f"_bucket={b}" for b in touched} and len(touched) <= 5
    plain = tables.insert_rows(tables.delete_rows(tables.update_rows(table, updates, "k"), deletes, "k"), inserts)
    assert sorted(stored_tables.read_buckets(spark, path).select("k", "name", "v").collect(), key=str) == sorted(plain.select("k", "name", "v").collect(), key=str)
    assert stored_tables.change_buckets(spark, path, "k", 16) == []


def test_emptied_buckets_go(spark, tmp_path):
    path, table = str(tmp_path / "b"), people(spark, 40)
    stored_tables.write_buckets(table, path, "k", 8)
    stored_tables.change_buckets(spark, path, "k", 8, deletes=table.select("k").where("k <> 7"))
    assert [r.k for r in stored_tables.read_buckets(spark, path).collect()] == [7] and len(stamps(path)) == 1


def test_merged_batches_hold_the_newest_counts(spark, tmp_path):
    path, keys = str(tmp_path / "c"), ["s"]
    for batch, n in enumerate((1, 4, 6)):
        rows = spark.createDataFrame([("2024-01-01", "a", 1.5, n, batch), ("2024-01-02", "a", float(batch), 1, batch)], "date string, s string, _value double, _n long, batch_id long")
        rows.write.parquet(f"{path}/batch={batch}")
        if batch == 1:
            assert sensor_stream.merge_batches(spark, path, keys) == 1 and sorted(os.listdir(path)) == ["merged=1"]
    newest = lambda: {(r.date, r._value): r._n for r in sensor_stream.latest_counts(spark, path, keys).collect()}
    want = {("2024-01-01", 1.5): 6, ("2024-01-02", 0.0): 1, ("2024-01-02", 1.0): 1, ("2024-01-02", 2.0): 1}
    assert newest() == want
    # A job that died between writing the merged folder and dropping the old ones.
    spark.read.parquet(f"{path}/merged=1").write.parquet(f"{path}/merged=0")
    assert newest() == want and sensor_stream.merge_batches(spark, path, keys) == 2
    assert sorted(os.listdir(path)) == ["merged=2"] and newest() == want


def test_nearest_in_time_equals_all_pairs(spark):
    """Ties, equal times, crowded buckets, both sides of midnight, rows without a key or time."""
    import datetime as dt
    import random

    rng, t0 = random.Random(2), dt.datetime(2024, 1, 1, 22)
    at = lambda: t0 + dt.timedelta(seconds=rng.choice([0, 1800, 3600, 5400, rng.randrange(40_000)]))
    rows = [(k, rng.choice(["a", "b", None]), at() if k % 17 else None) for k in range(300)]
    events = [(rng.choice(["a", "b", None]), at() if k % 7 else None, k % 5) for k in range(25)]
    left, right = spark.createDataFrame(rows, "id int, s string, t timestamp"), spark.createDataFrame(events, "s string, e timestamp, tile int")
    for within in (600, 5400, 90_000):
        got = {r.id: (r.e, r.tile, r.seconds_away) for r in matching.nearest_in_time(left, right, ["s"], "t", "e", within, ["tile"]).collect()}
        want = {}
        for k, s, t in rows:
            near = [(abs((e - t).total_seconds()), e, tile, (e - t).total_seconds()) for z, e, tile in events if s is not None and z == s and t and e]
            if near and min(near)[0] <= within:
                want[k] = min(near)[1:]
        assert got == want
