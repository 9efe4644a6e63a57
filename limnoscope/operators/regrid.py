"""Pixels on another grid: means of bands, the commonest class, the nearest pixel on a finer grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions.masks import SCL_LABELS, require_columns
from limnoscope.operators.spatial import PIXEL_SIZE
from limnoscope.schemas import SCENE_KEYS


def _cell(c: str, scale: float, size: float, origin: float) -> Column:
    """Number of the output cell that holds a pixel centre; cells begin at the outer edge of the grid's first pixel."""
    return F.floor((F.col(c) - F.lit(origin - size / 2.0)) / F.lit(float(scale)))


def _centre(cell: str, scale: float, size: float, origin: float) -> Column:
    return (F.col(cell) + 0.5) * F.lit(float(scale)) + F.lit(origin - size / 2.0)


def _commonest(counts: Sequence[str], classes: Sequence[int]) -> Column:
    """The class of the largest count, the smallest class on a tie; NULL where no pixel has a class."""
    listed = F.array(*[F.struct(F.col(n).alias("n"), F.lit(-c).alias("c")) for n, c in zip(counts, classes)])
    most = F.array_max(listed)
    return F.when(most["n"] > 0, -most["c"]).cast("int")


def coarser(
    pixels: DataFrame,
    bands: Sequence[str],
    scale: float,
    classes: Sequence[str] = (),
    size: float = PIXEL_SIZE,
    origin: float = 0.0,
    keys: Sequence[str] = SCENE_KEYS,
    codes: Sequence[int] = tuple(SCL_LABELS),
) -> DataFrame:
    """Cells of width `scale`: the mean of each band's valid pixels, the commonest code of each class column.

    Codes are counted in columns of their own, so one hash aggregation on the cell does it all and partial sums are what
    is shuffled. `area_m2` is the area of the pixels behind a cell and `n_pixels` their number.
    """
    require_columns(pixels, [*bands, *classes])
    placed = pixels.withColumns({"cell_x": _cell("x", scale, size, origin), "cell_y": _cell("y", scale, size, origin)})
    counts = {c: [f"_{c}_{k}" for k in codes] for c in classes}
    counted = [F.count_if(F.col(c) == k).alias(n) for c in classes for k, n in zip(codes, counts[c])]
    summed = placed.groupBy(*keys, "cell_x", "cell_y").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("area_m2").alias("area_m2"), *[F.avg(F.col(f"`{b}`")).alias(b) for b in bands], *counted
    )
    return summed.select(
        *keys, _centre("cell_x", scale, size, origin).alias("x"), _centre("cell_y", scale, size, origin).alias("y"), "area_m2", "n_pixels",
        *[F.col(f"`{b}`") for b in bands], *[_commonest(counts[c], codes).alias(c) for c in classes],
    )


def finer(
    pixels: DataFrame, bands: Sequence[str], scale: float, classes: Sequence[str] = (), size: float = PIXEL_SIZE, origin: float = 0.0,
    keys: Sequence[str] = SCENE_KEYS,
) -> DataFrame:
    """Cells narrower than a pixel, each with the values of the pixel that holds its centre. No shuffle."""
    require_columns(pixels, [*bands, *classes])
    shift, unit = F.lit(origin - size / 2.0), F.lit(float(scale))

    def inside(c: str) -> Column:
        # Cells whose centre lies in [c - size / 2, c + size / 2).
        low = F.ceil((F.col(c) - size / 2.0 - shift) / unit - 0.5)
        high = F.ceil((F.col(c) + size / 2.0 - shift) / unit - 0.5) - 1
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    cells = pixels.withColumn("cell_x", inside("x")).withColumn("cell_y", inside("y"))
    return cells.select(
        *keys, _centre("cell_x", scale, size, origin).alias("x"), _centre("cell_y", scale, size, origin).alias("y"),
        F.lit(float(scale) ** 2).alias("area_m2"), F.lit(1).cast("long").alias("n_pixels"), *[F.col(f"`{c}`") for c in (*bands, *classes)],
    )


def regrid(
    pixels: DataFrame, bands: Sequence[str], scale: float, classes: Sequence[str] = (), size: float = PIXEL_SIZE, origin: float = 0.0,
    keys: Sequence[str] = SCENE_KEYS,
) -> DataFrame:
    """Pixels of width `size` on a grid of width `scale`."""
    if scale <= 0:
        raise ValueError(f"a grid cannot have the scale {scale}")
    return (coarser if scale >= size else finer)(pixels, bands, scale, classes, size, origin, keys)
