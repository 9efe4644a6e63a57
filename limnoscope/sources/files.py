"""CSV inputs: points, precomputed dates, field samples and sensor exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnoscope.functions import temporal
from limnoscope.functions.numeric import lenient_double
from limnoscope.schemas import MODEL_CONFIG, POI_CSV, VALID_DATE_CSV
from limnoscope.sources import any_headers

POINT_COLUMNS = {"nombre", "latitud", "longitud"}
TIME_COLUMN = "Fecha-hora"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(reservoir, point, lat, lon)."""
    raw = spark.read.schema(POI_CSV).option("header", True).csv(path)
    return raw.select(
        F.col("embalse").alias("reservoir"), F.col("nombre").alias("point"),
        F.col("latitud").alias("lat"), F.col("longitud").alias("lon"),
    )


def read_uploaded_points(spark: SparkSession, path: str, reservoir: str) -> DataFrame:
    """Points of one reservoir; headers may differ in case and surrounding blanks."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lower().strip() for c in raw.columns])
    if not POINT_COLUMNS <= set(raw.columns):
        raise ValueError(f"the file needs the columns {sorted(POINT_COLUMNS)}")
    return raw.select(
        F.lit(reservoir).alias("reservoir"), F.col("nombre").alias("point"),
        lenient_double(F.col("latitud")).alias("lat"), lenient_double(F.col("longitud")).alias("lon"),
    )


def read_valid_dates(
    spark: SparkSession, path: str, reservoir: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """(reservoir, date, cloud_pct); unreadable dates dropped, the least cloudy row of a repeated date kept."""
    raw = spark.read.schema(VALID_DATE_CSV).option("header", True).csv(path)
    rows = raw.select(
        F.lit(reservoir).alias("reservoir"), F.col("fecha").try_cast("date").alias("date"),
        lenient_double(F.col("nubosidad")).alias("cloud_pct"),
    ).na.drop(subset=["date"])
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows.groupBy("reservoir", "date").agg(F.min("cloud_pct").alias("cloud_pct")).orderBy("date")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Stored calibration configurations."""
    return spark.read.schema(MODEL_CONFIG).json(path)


def read_sensor_exports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Concatenate sensor files with differing headers in one scan; missing and empty files are skipped."""
    found = any_headers.existing(spark, paths)
    lines = any_headers.read_lines(spark, found) if found else None
    names = any_headers.column_names(lines) if lines is not None else []
    if not names:
        raise FileNotFoundError(f"no readable sensor file among {list(paths)}")
    rest = [n for n in names if n not in ("Time", TIME_COLUMN)]
    time = F.coalesce(any_headers.field(TIME_COLUMN), any_headers.field("Time"))
    return lines.select(temporal.lenient_timestamp(time).alias(TIME_COLUMN), *[any_headers.field(n).alias(n) for n in rest])


def read_insitu_uploads(spark: SparkSession, path: str, targets: Sequence[str] | None = None) -> DataFrame:
    """(ts, variable, value) from files with `date`, `time` and any numeric columns, in any order, in one scan.

    Without `targets`, every column counts that holds a number somewhere; fields that are no numbers are left out.
    """
    lines = any_headers.read_lines(spark, path)
    lacking = lines.where(~F.array_contains("names", "date") | ~F.array_contains("names", "time")).select("names").limit(1).collect()
    if lacking:
        raise ValueError(f"missing columns {sorted({'date', 'time'} - set(lacking[0].names))}")
    rows = any_headers.as_rows(lines, ["date", "time"])
    if targets is not None:
        rows = rows.where(F.col("variable").isin(*targets))
    read = rows.select(
        temporal.combined_timestamp(F.col("date"), F.col("time")).alias("ts"), "variable", lenient_double(F.col("value")).alias("value")
    )
    return read.na.drop(subset=["ts", "value"])
