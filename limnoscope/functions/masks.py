"""Pixel masks over the scene classification (SCL) and the cloud probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Scene classification codes.
SCL_LABELS = {
    1: ("Píxeles saturados/defectuosos", "Saturated/defective pixels"),
    2: ("Área oscura", "Dark area pixels"),
    3: ("Sombras de nube", "Cloud shadows"),
    4: ("Vegetación", "Vegetation"),
    5: ("Suelo desnudo", "Bare soil"),
    6: ("Agua", "Water"),
    7: ("Prob. baja de nubes / No clasificada", "Low cloud probability / Unclassified"),
    8: ("Prob. media de nubes", "Medium cloud probability"),
    9: ("Prob. alta de nubes", "High cloud probability"),
    10: ("Cirro", "Cirrus"),
    11: ("Nieve o hielo", "Snow or ice"),
}
LAND = (4, 5)
SCREENING_CLOUDS = (7, 8, 9, 10)
INDEX_CLOUDS = (8, 9, 10)
DARK, WATER = 2, 6
CLOUD_PROBABILITY_LIMIT = 10
DARK_WATER_YEAR = 2018


def in_screening(scl: Column) -> Column:
    """Pixels that count when a scene is screened; NULL class means masked."""
    return ~scl.isin(*LAND)


def is_cloud(scl: Column) -> Column:
    return scl.isin(*SCREENING_CLOUDS)


def is_probable_cloud(probability: Column) -> Column:
    return probability >= CLOUD_PROBABILITY_LIMIT


def clear_for_indices(scl: Column) -> Column:
    """Low-probability clouds (7) stay in."""
    return ~scl.isin(*INDEX_CLOUDS)


def is_water(scl: Column, scene_date: Column, dark_year: int = DARK_WATER_YEAR) -> Column:
    """Water, and in one year also dark pixels."""
    return (scl == WATER) | ((scl == DARK) & (F.year(scene_date) == dark_year))


def masked(value: Column, keep: Column) -> Column:
    return F.when(keep, value)


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df
