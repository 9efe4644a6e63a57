"""Spectral indices as column builders over reflectance.

Digital numbers are divided by 10000 once. A zero denominator or a masked band gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from limnoscope.functions.masks import clear_for_indices, masked, require_columns
from limnoscope.functions.numeric import at_least_zero, filled

Bands = dict[str, Column]

CHLOROPHYLL, PHYCOCYANIN, PREDICTOR = "chlorophyll", "phycocyanin", "predictor"
EVERY_RESERVOIR = "*"


@dataclass(frozen=True)
class SpectralIndex:
    name: str
    bands: tuple[str, ...]
    build: Callable[[Bands], Column]
    family: str = PREDICTOR
    # Reservoir key the index was fitted for, `*` for all, None for predictors.
    reservoir: str | None = None
    cloud_masked: bool = False


def _normalised(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def _red_edge_peak(r: Bands) -> Column:
    # Height of 705 nm over the line from 665 to 740 nm.
    return r["b5"] - r["b4"] - (r["b6"] - r["b4"]) * 40.0 / 75.0


def _above_baseline(r: Bands) -> Column:
    # The same height, added up from the baseline; the last digit may differ.
    return r["b5"] - (r["b4"] + (r["b6"] - r["b4"]) * (40.0 / 75.0))


def _logistic(top: float, slope: float, middle: float, x: Column) -> Column:
    return F.try_divide(F.lit(top), 1.0 + F.exp((x - middle) * -slope))


def _ratio(a: str, b: str) -> Callable[[Bands], Column]:
    return lambda r: F.try_divide(r[a], r[b])


def _difference(a: str, b: str) -> Callable[[Bands], Column]:
    return lambda r: r[a] - r[b]


def _ndi(a: str, b: str) -> Callable[[Bands], Column]:
    return lambda r: _normalised(r[a], r[b])


# Names, formulas and coefficients of the water-quality indices.
_WATER_QUALITY = [
    SpectralIndex("MCI", ("b4", "b5", "b6"), _red_edge_peak, CHLOROPHYLL, EVERY_RESERVOIR, True),
    SpectralIndex("PCI_B5/B4", ("b4", "b5"), _ratio("b5", "b4"), PHYCOCYANIN, EVERY_RESERVOIR, True),
    SpectralIndex("NDCI_ind", ("b4", "b5"), _ndi("b5", "b4"), CHLOROPHYLL, EVERY_RESERVOIR, True),
    SpectralIndex(
        "PC_Val_cal", ("b4", "b5"),
        lambda r: at_least_zero(_logistic(100.0, 4.6755, 1.9895, F.try_divide(r["b5"], r["b4"]))),
        PHYCOCYANIN, "val", True,
    ),
    SpectralIndex(
        "Chla_Val_cal", ("b4", "b5"),
        lambda r: at_least_zero(_logistic(450.0, 7.14, 0.46, _normalised(r["b5"], r["b4"]))),
        CHLOROPHYLL, "val", True,
    ),
    SpectralIndex(
        "PC_Bellus_cal", ("b3", "b6", "b8a"),
        lambda r: at_least_zero(
            16957.0 * (r["b6"] - (0.96 * r["b8a"] + 0.51 * (r["b3"] - r["b8a"]))) + 571.0
        ),
        PHYCOCYANIN, "bellus", True,
    ),
    SpectralIndex(
        "Chla_Bellus_cal", ("b4", "b5"),
        lambda r: at_least_zero(112.78 * _normalised(r["b5"], r["b4"]) + 10.779),
        CHLOROPHYLL, "bellus", True,
    ),
    SpectralIndex(
        "UV_PC_Gral_cal", ("b4", "b5"),
        lambda r: at_least_zero(24.665 * F.pow(F.try_divide(r["b5"], r["b4"]), F.lit(3.4607))),
        PHYCOCYANIN, EVERY_RESERVOIR, True,
    ),
]

# Names and formulas of the calibration predictors.
_PREDICTORS = [
    SpectralIndex("NDCI_705_665", ("b4", "b5"), _ndi("b5", "b4")),
    SpectralIndex("MCI_705", ("b4", "b5", "b6"), _above_baseline),
    SpectralIndex("R705_R665", ("b4", "b5"), _ratio("b5", "b4")),
    SpectralIndex("R740_R665", ("b4", "b6"), _ratio("b6", "b4")),
    SpectralIndex("R783_R665", ("b4", "b7"), _ratio("b7", "b4")),
    SpectralIndex("TB_740", ("b5", "b6"), _difference("b6", "b5")),
    SpectralIndex("TB_783", ("b5", "b7"), _difference("b7", "b5")),
    SpectralIndex("NDRE_783_705", ("b5", "b7"), _ndi("b7", "b5")),
    SpectralIndex("NDRE_740_705", ("b5", "b6"), _ndi("b6", "b5")),
    SpectralIndex("B5_B4_diff", ("b4", "b5"), _difference("b5", "b4")),
    SpectralIndex("B6_B5_diff", ("b5", "b6"), _difference("b6", "b5")),
    SpectralIndex("B7_B5_diff", ("b5", "b7"), _difference("b7", "b5")),
]

WATER_QUALITY_NAMES = tuple(i.name for i in _WATER_QUALITY)
PREDICTOR_NAMES = tuple(i.name for i in _PREDICTORS)

_registry: dict[str, SpectralIndex] = {i.name: i for i in _WATER_QUALITY + _PREDICTORS}


def register(index: SpectralIndex) -> None:
    """Add an index of one's own; every operator then accepts its name."""
    if index.name in _registry:
        raise ValueError(f"index {index.name!r} exists")
    _registry[index.name] = index


def catalogue() -> list[SpectralIndex]:
    return list(_registry.values())


def lookup(names: Iterable[str]) -> list[SpectralIndex]:
    names = list(names)
    unknown = [n for n in names if n not in _registry]
    if unknown:
        raise ValueError(f"unknown indices {unknown}")
    return [_registry[n] for n in names]


def reflectance(band: str) -> Column:
    return F.col(band) / F.lit(10000.0)


def scaled_bands(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands as reflectance. Index builders scale by themselves, so this is for export of bands only."""
    require_columns(pixels, bands)
    return pixels.withColumns({b: reflectance(b) for b in bands})


def index_column(name: str) -> Column:
    """The index, masked by cloud class where the index asks for it.

    A name outside the registry is a column the pixels already carry, such as a calibrated band.
    """
    if name not in _registry:
        return F.col(f"`{name}`")
    (index,) = lookup([name])
    value = index.build({b: reflectance(b) for b in index.bands})
    return masked(value, clear_for_indices(F.col("scl"))) if index.cloud_masked else value


def check_bands(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail before the job starts when a band of a wanted index is absent."""
    wanted = lookup([n for n in names if n in _registry or n not in pixels.columns])
    needed = {b for i in wanted for b in i.bands}
    if any(i.cloud_masked for i in wanted):
        needed.add("scl")
    return require_columns(pixels, needed)


def with_indices(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add all wanted indices in one projection."""
    check_bands(pixels, names)
    return pixels.withColumns({n: index_column(n) for n in names})
