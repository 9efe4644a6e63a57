"""Number helpers that keep NULL as the mask."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lenient_double(value: Column) -> Column:
    """Number from text, NULL where it does not parse."""
    return value.try_cast("double")


def comma_decimal(text: Column) -> Column:
    """`12,5` and `12.5` are both twelve and a half. Text that cannot be a number is not tried, as a failure costs far more."""
    number = lenient_double(F.replace(F.trim(text), F.lit(","), F.lit(".")))
    return F.when(text.rlike("(?i)[0-9]|inf|nan"), number)


def at_least_zero(value: Column) -> Column:
    """Clamp at zero. `greatest` would turn a masked pixel into a zero."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def filled(value: Column, fill: float) -> Column:
    """Replace a masked value."""
    return F.coalesce(value, F.lit(float(fill)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 when the whole is empty."""
    return F.coalesce(100.0 * F.try_divide(part, whole), F.lit(0.0))


def class_edges(low: float, high: float, classes: int) -> Column:
    """Equally spaced class edges as an array column."""
    step = lambda i: F.lit(float(low)) + i * F.lit(float(high - low)) / F.lit(float(classes))
    return F.transform(F.sequence(F.lit(0), F.lit(int(classes))), step)


def class_label(low: Column, high: Column) -> Column:
    return F.concat(low.cast("string"), F.lit("–"), high.cast("string"))
