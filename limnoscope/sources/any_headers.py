"""Text files whose headers differ from file to file, read in one scan whatever their number.

The first line of every file names its columns. Headers are one small row per file; every line is cut once and finds its
columns by their place in its own file's header, so files with other columns or another order need no reader of their own.
Quoted fields may hold commas, but no line breaks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limnoscope.operators.sizing import lookup_join

#: Headers wider than this are an error, since a schema must be finite.
MOST_COLUMNS = 4096


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that name a file or folder, in the given order."""
    context = spark.sparkContext
    found = []
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        matches = place.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(place)
        if matches is not None and len(matches):
            found.append(path)
    return found


def _fields(line: str, width: int) -> Column:
    """The fields of a line as an array of strings; absent ones are NULL."""
    schema = ", ".join(f"c{k} string" for k in range(width))
    cut = F.from_csv(F.col(line), schema, {"mode": "PERMISSIVE", "escape": '"'})
    return F.array(*[cut[f"c{k}"] for k in range(width)])


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, names, fields): every line below a header, cut into fields, with the names of its file's columns.

    Blank lines are left out, and so are files without a line. A file that occurs in a third of all lines is spread like
    any other hot key of a lookup.
    """
    text = spark.read.text(paths if isinstance(paths, str) else list(paths)).where("trim(value) <> ''")
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # Only a file's first block can hold its header.
    headers = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    commas = headers.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))).alias("n")).first().n
    width = (commas or 0) + 1
    if width > MOST_COLUMNS:
        raise ValueError(f"a header has {width} columns, more than {MOST_COLUMNS}")
    named = headers.select("file", "header", F.transform(_fields("header", width), lambda c: F.trim(F.regexp_replace(c, "^\uFEFF", ""))).alias("names"))
    joined = lookup_join(lines, named, ["file"], ["at"])
    # A header that stands in the middle of a file, as in files put together, is no data either.
    return joined.where("value <> header").select("file", "names", _fields("value", width).alias("fields"))


def column_names(lines: DataFrame) -> list[str]:
    """Distinct names of all headers, in the order of the files and of their columns."""
    names = lines.select("file", F.posexplode("names").alias("place", "name")).where("name is not null and name <> ''")
    first = names.groupBy("name").agg(F.min(F.struct("file", "place")).alias("first")).orderBy("first", "name")
    return [r.name for r in first.limit(MOST_COLUMNS).collect()]


def field(name: str) -> Column:
    """The field under a name; NULL where the file has no such column. Of equal names the first counts."""
    return F.get("fields", F.array_position("names", F.lit(name)).cast("int") - 1)


def as_columns(lines: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One string column per name of any header, NULL where a file lacks it."""
    return lines.select(*[field(n).alias(n) for n in (column_names(lines) if names is None else names)])


def as_rows(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., variable, value) for every field outside `keep`, without knowing any other name."""
    pairs = F.filter(F.arrays_zip(F.col("names").alias("variable"), F.col("fields").alias("value")), lambda p: ~F.coalesce(p["variable"], F.lit("")).isin("", *keep))
    return lines.select(*[field(k).alias(k) for k in keep], F.inline(pairs))
