"""Search, paging, keyed changes and column profiles of stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from limnoscope.functions.text import any_column_contains
from limnoscope.operators.reshape import union_all


def search(table: DataFrame, term: str | None, columns: Sequence[str]) -> DataFrame:
    return table.where(any_column_contains(columns, term)) if term and columns else table


def page(
    table: DataFrame, limit: int, offset: int = 0, term: str | None = None, columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row total) under the same filter, newest key first."""
    found = search(table, term, columns)
    rows = found.orderBy(F.col(table.columns[0]).desc()).offset(offset).limit(limit)
    return rows, found.agg(F.count(F.lit(1)).alias("total"))


def preview(table: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    return table.orderBy(*order).limit(rows)


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return union_all([table, rows]).select(*table.columns)


def update_rows(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New version in which rows named by `changes` take its values, NULL included; the key never changes.

    Of several changes of one key the last by `order` counts; without an order they are an error.
    """
    touched = [c for c in changes.columns if c not in (key, order)]
    values = F.struct(F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in touched])
    if order is None:
        twice = F.raise_error(F.concat(F.lit("several changes of key "), F.col(key).cast("string")))
        folded = changes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(values).alias("_c"))
        folded = folded.select(key, F.when(F.col("_n") > 1, twice.cast(folded.schema["_c"].dataType)).otherwise(F.col("_c")).alias("_c"))
    else:
        folded = changes.groupBy(key).agg(F.max_by(values, F.col(order)).alias("_c"))
    renamed = folded.select(key, "_c.*")
    joined = table.join(renamed, key, "left")
    new = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[new(c) if c in touched else F.col(c) for c in table.columns])


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def column_profile(table: DataFrame) -> DataFrame:
    """Name, type, nullability and type class of each column, with rows present and rows that read as numbers.

    All counts come from one aggregation of the table.
    """
    counts = []
    for i, field in enumerate(table.schema.fields):
        as_number = F.col(f"`{field.name}`").cast("string").try_cast("double")
        counts += [F.count(F.col(f"`{field.name}`")).alias(f"p{i}"), F.count(as_number).alias(f"n{i}")]
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
            F.lit(type_class(f.dataType)).alias("type_class"),
            F.col(f"p{i}").alias("n_present"), F.col(f"n{i}").alias("n_numeric"),
        )
        for i, f in enumerate(table.schema.fields)
    ]
    return table.agg(*counts).select(F.inline(F.array(*entries)))


def numeric_candidates(table: DataFrame, excluded: Sequence[str] = ("date", "time")) -> DataFrame:
    """Columns with at least one value that reads as a number."""
    return column_profile(table.select(*[F.col(f"`{c}`") for c in table.columns if c not in excluded])).where(
        F.col("n_numeric") > 0
    )


def unpivot_targets(table: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(date, time, variable, value) rows of the chosen numeric columns."""
    texts = [F.col(f"`{t}`").cast("string").alias(t) for t in targets]
    return table.select("date", "time", *texts).unpivot(["date", "time"], list(targets), "variable", "value")
