"""Sensor pages to the stored sensor table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limnoscope.operators import sensors
from limnoscope.sources import html_tables


def pages_to_sensor_rows(pages: DataFrame, reservoir_code: str, lon: float, lat: float) -> DataFrame:
    """Rows of stored pages in the sensor schema; of repeated rows the first by page and row stays."""
    found = html_tables.sensor_rows(pages).withColumn("ingest_id", F.expr("cast(page_id as decimal(19,0)) * 10000000000 + row_no"))
    rows = sensors.to_sensor_rows(found, reservoir_code, lon, lat, ts=F.col("date_time"), keep=["ingest_id"])
    return sensors.drop_repeated(rows).drop("ingest_id")
