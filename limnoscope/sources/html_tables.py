"""Sensor tables inside stored web pages, read with SQL string functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions import temporal, text
from limnoscope.functions.numeric import comma_decimal

VALID_CLASS = "f1"

# Header words of the sensor tables and the stored names.
HEADER_WORDS = {
    "Fecha": "date_time",
    "Ficocianina": "phycocyanin",
    "Temperatura": "water_temp",
    "Turbidez": "turbidity",
    "Clorofila": "chlorophyll",
}
DEPTH_HEADER = "Profundidad maxima embalse (m)"


def _elements(html: Column, tag: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(group))


def _raw_cells(row: Column, group: int) -> Column:
    """Attributes (2) or contents (3) of the cells of a row."""
    return F.regexp_extract_all(row, F.lit(r"(?is)<t([hd])\b([^>]*)>(.*?)</t[hd]\s*>"), F.lit(group))


def _css(attributes: Column) -> Column:
    return F.regexp_extract(attributes, r"""(?i)\bclass\s*=\s*["']?([^"'\s>]+)""", 1)


def _cells(row: Column) -> Column:
    return F.zip_with(
        _raw_cells(row, 3), _raw_cells(row, 2), lambda c, a: F.struct(text.plain_cell(c).alias("text"), _css(a).alias("css"))
    )


def list_items(pages: DataFrame) -> DataFrame:
    """(page_id, position, text) of every list item."""
    items = F.posexplode(_elements(F.col("html"), "li"))
    found = pages.select("page_id", items).withColumnRenamed("pos", "position")
    return found.select("page_id", "position", text.plain_cell(F.col("col")).alias("text"))


def _header(first_row: Column) -> Column:
    """Plain texts of the cells of a first row. One step after the other: within a step nothing is computed only once."""
    return F.transform(F.transform(_raw_cells(first_row, 3), text.plain_cell), text.strip_accents)


def _body_rows(tables: DataFrame) -> DataFrame:
    """One row per body row: `row_no` and `_row` in place of `_table`.

    Exploding between the steps keeps the optimizer from repeating a pattern match in a later filter.
    """
    keep = [c for c in tables.columns if c != "_table"]
    rows = tables.select(*keep, F.posexplode(_elements(F.col("_table"), "tr")).alias("_pos", "_row"))
    return rows.where(F.col("_pos") > 0).select(*keep, (F.col("_pos") - 1).alias("row_no"), "_row")


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, header, row_no, cells) of every table; its first row is the header."""
    tables = pages.select("page_id", F.posexplode(_elements(F.col("html"), "table")).alias("table_no", "_table"))
    rows = _body_rows(tables.withColumn("header", _header(_first_row(F.col("_table")))))
    return rows.select("page_id", "table_no", "header", "row_no", _cells(F.col("_row")).alias("cells"))


def _first_row(table: Column) -> Column:
    return F.regexp_extract(table, r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", 1)


def _tables_headed(html: Column, word: str) -> Column:
    """(_table, _first) of the tables whose first row contains `word`. Each step binds what the next one reads again."""
    tables = F.transform(_elements(html, "table"), lambda t: F.struct(t.alias("_table"), _first_row(t).alias("_first")))
    read = F.transform(tables, lambda t: F.struct(t["_table"].alias("_table"), t["_first"].alias("_first"), text.plain_cell(t["_first"]).alias("_plain")))
    return F.filter(read, lambda t: text.strip_accents(t["_plain"]).contains(word))


def _row_time(day: Column, hour: Column) -> Column:
    """Time from one column, or from a date and an hour column."""
    return F.coalesce(
        temporal.lenient_timestamp(day, (temporal.SENSOR_PAGE_FORMAT,)), temporal.combined_timestamp(day, hour)
    )


def sensor_rows(pages: DataFrame, word: str = "Ficocianina") -> DataFrame:
    """Measured rows of the first table of each page whose header contains `word`.

    Numbers may use a decimal comma. A depth counts only in a cell marked valid. Rows without time or
    without the measure named by `word` are dropped.
    """
    tables = pages.select("page_id", F.inline(F.slice(_tables_headed(F.col("html"), word), 1, 1)))
    headed = tables.select("page_id", "_table", _header(F.col("_first")).alias("header"))
    # Places of the columns are found once per table.
    place = lambda matches: F.array_position(F.transform("header", matches), F.lit(True)).cast("int")
    places = {name: place(_contains(word)) for word, name in HEADER_WORDS.items()}
    places["hour"] = place(lambda h: h.contains("Hora") & ~h.contains("Fecha"))
    places["depth"] = place(lambda h: h == F.lit(DEPTH_HEADER))
    placed = headed.select("page_id", "_table", *[p.alias(f"_at_{n}") for n, p in places.items()])

    # Only cells in these places are read, and attributes only where a depth is.
    at = lambda cells, name: F.when(F.col(f"_at_{name}") > 0, F.get(F.col(cells), F.col(f"_at_{name}") - 1))
    attributes = F.when(F.col("_at_depth") > 0, _raw_cells(F.col("_row"), 2))
    cut = _body_rows(placed).withColumns({"_contents": _raw_cells(F.col("_row"), 3), "_attributes": attributes})
    # One expression reads a row, step by step: unrolled, the generated method would be too long to be compiled.
    texts = F.transform(F.array(*[at("_contents", n) for n in places]), text.plain_cell)
    row = F.struct(texts.alias("texts"), _css(at("_attributes", "depth")).alias("css"))

    def values(r: Column) -> Column:
        cell = {n: F.get(r["texts"], F.lit(k)) for k, n in enumerate(places)}
        found = {n: comma_decimal(cell[n]) for n in HEADER_WORDS.values() if n != "date_time"}
        found["date_time"] = _row_time(cell["date_time"], cell["hour"])
        found["depth"] = F.when(r["css"] == VALID_CLASS, comma_decimal(cell["depth"]))
        return F.struct(*[v.alias(n) for n, v in found.items()])

    read = F.inline(F.transform(F.array(row), values))
    return cut.select("page_id", "row_no", read).na.drop(subset=["date_time", HEADER_WORDS[word]])


def _contains(word: str):
    return lambda header: header.contains(word)
