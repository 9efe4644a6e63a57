"""Sensor feeds: normalise, merge, remove repeated rows, cut time into periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from limnoscope.functions import temporal
from limnoscope.functions.numeric import lenient_double
from limnoscope.schemas import SENSOR, SENSOR_IDENTITY


def rename_by_substring(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the columns whose header contains a key, under the new name; the first rule that fits wins."""
    chosen: dict[str, str] = {}
    for column in df.columns:
        for part, name in names.items():
            if part.lower() in column.lower() and name not in chosen.values():
                chosen[column] = name
                break
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in chosen.items()])


def to_sensor_rows(
    df: DataFrame, reservoir_code: str, lon: float, lat: float, ts: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Bring a feed to the stored schema; rows without time or phycocyanin are dropped."""
    ts = ts if ts is not None else temporal.lenient_timestamp(F.col("date_time").cast("string"))
    constants = {"reservoir_code": F.lit(reservoir_code), "lon": F.lit(float(lon)), "lat": F.lit(float(lat))}
    columns = []
    for field in SENSOR.fields:
        if field.name == "date_time":
            value = ts
        elif field.name in constants:
            value = constants[field.name]
        elif field.name in df.columns:
            # What is a number already is taken as it is; text is read.
            number = df.schema[field.name].dataType == DoubleType()
            value = F.col(field.name) if number else lenient_double(F.col(field.name).cast("string"))
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns, *keep).na.drop(subset=["date_time", "phycocyanin"])


#: Digits that the hash of a row adds to its ingest number.
_HASH_DIGITS = 9


def drop_repeated(
    df: DataFrame, identity: Sequence[str] = SENSOR_IDENTITY, ingest_order: str = "ingest_id"
) -> DataFrame:
    """Keep the first ingested of equal rows; NULL measures count as equal.

    Rows are ordered by the ingest number (a whole number of up to 29 digits) followed by a hash of the row, so rows that
    share a number never mix. The order and the columns of fixed width fit a hash aggregation: copies are folded before
    the shuffle, and a row copied a million times sends one row per input task. Further text columns make it a sort.
    """
    rest = [c for c in df.columns if c not in identity and c != ingest_order]
    number = F.col(ingest_order).cast("decimal(29,0)")
    by_hash = F.pmod(F.xxhash64(*rest, F.lit(0)), F.lit(10**_HASH_DIGITS)).cast("decimal(9,0)")
    ordered = df.withColumn("_order", (number * F.lit(10**_HASH_DIGITS).cast("decimal(10,0)") + by_hash).cast("decimal(38,0)"))
    first = [F.min_by(c, "_order").alias(c) for c in [ingest_order, *rest]]
    return ordered.groupBy(*identity).agg(*first).select(*df.columns)


def merge_sensors(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer merge of two sensors on their time key."""
    return left.join(right, list(on), "full_outer")


def periods_of(spans: DataFrame, first: Column, last: Column, days: int = 90) -> DataFrame:
    """Cut each span into consecutive periods of `days` days; the last one ends with the span."""
    step = F.expr(f"interval {int(days)} days")
    starts = spans.select(last.alias("_last"), F.explode(F.sequence(first, last, step)).alias("period_start"))
    return starts.select(
        "period_start", F.least(F.date_add("period_start", days - 1), F.col("_last")).alias("period_end")
    )


def periods(
    spark: SparkSession, start: str, end: str, days: int = 90, exclude: tuple[str, str] | None = None
) -> DataFrame:
    """Periods between two dates, with an interval cut out of them."""
    whole = periods_of(spark.range(1), F.lit(start).cast("date"), F.lit(end).cast("date"), days)
    return subtract_interval(whole, *exclude) if exclude else whole


def subtract_interval(intervals: DataFrame, cut_start: str, cut_end: str) -> DataFrame:
    """What remains of each period before and after the cut; untouched periods stay whole."""
    cut_from, cut_to = F.lit(cut_start).cast("date"), F.lit(cut_end).cast("date")
    before = F.struct(
        F.col("period_start").alias("period_start"),
        F.least("period_end", F.date_sub(cut_from, 1)).alias("period_end"),
    )
    after = F.struct(
        F.greatest("period_start", F.date_add(cut_to, 1)).alias("period_start"),
        F.col("period_end").alias("period_end"),
    )
    parts = intervals.select(F.inline(F.array(before, after)))
    return parts.where(F.col("period_start") <= F.col("period_end"))


def previous_day(today: Column) -> Column:
    return F.date_sub(today, 1)


def recent(df: DataFrame, until: Column, day: str = "date", days: int = 15) -> DataFrame:
    """Rows of the last `days` days before `until`."""
    return df.where((F.col(day) > F.date_sub(until, days)) & (F.col(day) <= until))
