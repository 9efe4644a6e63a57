import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from limnoscope.plans.ingest import pages_to_sensor_rows
from limnoscope.schemas import PIXEL
from limnoscope.sources import aoi, files, html_tables, pixels, sinks

PAGE = """<html><table><tr><th>Otro</th></tr><tr><td>1</td></tr></table>
<table class="x"><thead><tr><th>Fecha</th><th>Ficocianina (&micro;g/L)</th><th>Temperatura</th><th>Turbidez</th>
<th>Profundidad m&aacute;xima embalse (m)</th></tr></thead><tbody>
<tr><td>05-03-2024 10:00:00</td><td>1,5</td><td>12,25</td><td>3</td><td class="f1">20,5</td></tr>
<tr><td>05-03-2024 11:00:00</td><td>2.5</td><td>-</td><td></td><td class="f2">20,5</td></tr>
<tr><td>no date</td><td>2.5</td><td>1</td><td>1</td><td class="f1">1</td></tr>
<tr><td>05-03-2024 12:00:00</td><td></td><td>1</td><td>1</td><td class="f1">1</td></tr>
<tr><td>05-03-2024 10:00:00</td><td>1,5</td><td>12,25</td><td>3</td><td class="f1">20,5</td></tr>
</tbody></table>
<table><tr><th>Ficocianina</th><th>Fecha</th></tr><tr><td>9</td><td>05-03-2024 10:00:00</td></tr></table></html>"""
CHLOROPHYLL = """<table><tr><th>Fecha</th><th>Hora</th><th>Clorofila</th></tr>
<tr><td>2024-03-05</td><td>10:20</td><td>7,5</td></tr></table>"""


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def test_sensor_pages(spark):
    rows = html_tables.sensor_rows(pages(spark, PAGE, "<p>none</p>")).orderBy("date_time", "row_no").collect()
    assert [(r["date_time"].hour, r["phycocyanin"], r["water_temp"], r["turbidity"], r["depth"]) for r in rows] == [
        (10, 1.5, 12.25, 3.0, 20.5), (10, 1.5, 12.25, 3.0, 20.5), (11, 2.5, None, None, None)
    ]
    stored = pages_to_sensor_rows(pages(spark, PAGE), "2351", -1.78, 41.87)
    assert stored.count() == 2 and stored.first()["reservoir_code"] == "2351"
    assert html_tables.table_rows(pages(spark, PAGE)).select("table_no").distinct().count() == 3


def test_date_and_hour_columns(spark):
    (row,) = html_tables.sensor_rows(pages(spark, CHLOROPHYLL), "Clorofila").collect()
    assert row["date_time"] == dt.datetime(2024, 3, 5, 10, 20) and row["chlorophyll"] == 7.5


def test_geojson(spark):
    square = [[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 1.5], [1, 1]]
    text = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NOMBRE": "El Val", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"NOMBRE": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}},
    ]})
    got = aoi.aoi_from_geojson(spark.createDataFrame([(text,)], "geojson string")).orderBy("name").collect()
    assert [r["name"] for r in got] == ["B", "El Val"]
    for r in got:
        assert [(p["x"], p["y"]) for p in r["ring"]] == [tuple(map(float, p)) for p in square]
        assert (r["minx"], r["maxx"], r["miny"], r["maxy"]) == (0, 4, 0, 2)


def test_csv_inputs(spark, tmp_path):
    poi = tmp_path / "poi.csv"
    poi.write_text("embalse,nombre,latitud,longitud\nVAL,V-1,41.8,-1.8\nVAL,V-2,41.9,-1.7\n")
    assert files.read_points(spark, str(poi)).columns == ["reservoir", "point", "lat", "lon"]
    own = tmp_path / "own.csv"
    own.write_text(" Nombre,LATITUD , longitud\na,1.5,2\nb,x,2\n")
    got = files.read_uploaded_points(spark, str(own), "R").orderBy("point").collect()
    assert [(r["point"], r["lat"]) for r in got] == [("a", 1.5), ("b", None)]
    own.write_text("nombre,lat\na,1\n")
    with pytest.raises(ValueError):
        files.read_uploaded_points(spark, str(own), "R")
    dates = tmp_path / "dates.csv"
    dates.write_text("fecha,nubosidad\n2020-01-01,5.5\n2020-01-01,3.5\nbad,1\n2020-02-01,\n2021-01-01,9\n")
    rows = files.read_valid_dates(spark, str(dates), "val", "2020-01-01", "2020-02-01").orderBy("date").collect()
    assert [(str(r["date"]), r["cloud_pct"]) for r in rows] == [("2020-01-01", 3.5), ("2020-02-01", None)]


def test_sensor_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Ficocianina (µg/L)\n2024-01-01 10:00:00,1.5\n01/02/2024 11:30,2.5\n")
    (tmp_path / "b.csv").write_text("Fecha-hora,Clorofila (µg/L)\n2024-01-03T00:00:00,4\n")
    (tmp_path / "empty.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "empty.csv", "missing.csv")]
    got = files.read_sensor_exports(spark, paths).orderBy("Fecha-hora").collect()
    assert [str(r["Fecha-hora"]) for r in got] == ["2024-01-01 10:00:00", "2024-01-03 00:00:00", "2024-02-01 11:30:00"]
    assert got[0]["Clorofila (µg/L)"] is None
    with pytest.raises(FileNotFoundError):
        files.read_sensor_exports(spark, paths[3:])


def test_insitu_uploads(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("date,time,phycocyanin,note,chlorophyll\n2024-01-01,10:00,1.5,x,\n2024-01-01,11:00,bad,y,3\nbad,1,1,z,1\n")
    got = files.read_insitu_uploads(spark, str(path)).orderBy("ts").collect()
    assert [(r["variable"], r["value"]) for r in got] == [("phycocyanin", 1.5), ("chlorophyll", 3.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("v = 1.5").count() == 1
    sinks.write_version(df, str(tmp_path / "v1"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_version(df, str(tmp_path / "v1"))


def test_pixel_table_prunes_months(spark, tmp_path):
    rows = []
    for i, day in enumerate([dt.date(2020, 1, 5), dt.date(2020, 2, 5), dt.date(2020, 2, 20), dt.date(2020, 4, 1)]):
        ts = dt.datetime(day.year, day.month, day.day, 10)
        rows.append((i, 1 + i % 2, day, 0, ts, 0.0, 0.0, 400.0, *[1.0] * 6, 6, 0, 5.0))
    path = str(tmp_path / "pixel")
    pixels.write_pixels(spark.createDataFrame(rows, PIXEL), path)
    found = pixels.read_pixels(spark, path, "2020-02-01", "2020-02-20")
    assert [r["pixel_id"] for r in found.collect()] == [1]
    assert pixels.read_pixels(spark, path, "2020-02-01", "2020-02-20", inclusive_end=True).count() == 2
    assert pixels.read_pixels(spark, path, reservoirs=[1]).count() == 2
    plan = found.select("pixel_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scene_month" in plan and "PushedFilters: [IsNotNull(scene_date)" in plan
    assert "b4" not in plan.split("ReadSchema")[1]
    stored = pixels.write_scene_table(found.groupBy("reservoir_id").count(), str(tmp_path / "scene"))
    assert stored.count() == 1


def test_sensor_append(spark, tmp_path):
    from limnoscope.operators.sensors import to_sensor_rows

    raw = spark.createDataFrame([("2024-01-01 10:00:00", "1.5"), ("x", "2")], "date_time string, phycocyanin string")
    rows = to_sensor_rows(raw, "R1", -1.0, 41.0)
    for _ in range(2):
        sinks.append_sensor_rows(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where(F.col("reservoir_code") == "R1").count() == 2


def test_each_pattern_of_a_page_is_matched_once(spark):
    """Nothing is matched again for a second use, and odd cells give what they gave."""
    texts = ["", "-", "sin dato", "NaN", "inf", "1e3", " 7,25 ", "4d", "0x1p3", "1.234,5", "<b>8</b>", "&nbsp;9"]
    rows = "".join(f"<tr><td>05-03-2024 10:00:{k:02d}</td><td>{t}</td><td class=f1>{k}</td></tr>" for k, t in enumerate(texts))
    head = "<tr><th>Fecha</th><th>Fico<i>cianin</i>a µg</th><th>Profundidad m&aacute;xima embalse (m)</th></tr>"
    found = html_tables.sensor_rows(pages(spark, f"<table><tr><td>x</td></tr></table><table>{head}{rows}</table>"))
    got = {r.row_no: (r.phycocyanin, r.depth) for r in found.collect()}
    want = {4: float("inf"), 5: 1000.0, 6: 7.25, 7: 4.0, 10: 8.0, 11: 9.0}
    assert {k: str(v) for k, (v, _) in got.items() if k != 8} == {k: str(v) for k, v in want.items()}
    assert all(depth == k for k, (_, depth) in got.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<table\\b") == 1 and plan.count("<tr\\b") == 2 and plan.count("<t([hd])\\b") == 3
