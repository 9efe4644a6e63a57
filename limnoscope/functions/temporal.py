"""Date and time helpers; the session zone is UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Time formats met in sensor files and pages.
SENSOR_PAGE_FORMAT = "dd-MM-yyyy HH:mm:ss"
SENSOR_FILE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy",
)


def lenient_timestamp(text: Column, formats: Sequence[str] = SENSOR_FILE_FORMATS) -> Column:
    """First format that parses; NULL when none does. Text that starts with no digit is not tried."""
    return F.when(
        text.rlike(r"^\s*\d"), F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])
    )


def combined_timestamp(date: Column, time: Column) -> Column:
    """Timestamp from a date column and a time column."""
    text = F.concat_ws(" ", F.trim(date.cast("string")), F.trim(time.cast("string")))
    return F.when(date.isNotNull() & time.isNotNull(), lenient_timestamp(text))


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def fractional_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.floor(F.second(ts)) / F.lit(3600.0)


def hour_within(ts: Column, first: int, last: int) -> Column:
    """Both hours included."""
    return F.hour(ts).between(first, last)


def day_range(day: Column, start: str, end: str, inclusive_end: bool = False) -> Column:
    """Half-open by default, as a scene search is."""
    upper = (day <= F.lit(end).cast("date")) if inclusive_end else (day < F.lit(end).cast("date"))
    return (day >= F.lit(start).cast("date")) & upper


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "dd-MM-yyyy HH:mm")


def display_day(day: Column) -> Column:
    return F.date_format(day, "dd MMM yyyy")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
