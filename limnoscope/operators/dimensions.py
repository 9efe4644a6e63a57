"""Small dimension tables: reservoir names and aliases, index catalogue, scene classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnoscope.functions import masks, spectral, text

# Spellings of the reservoirs that have indices of their own.
RESERVOIR_ALIASES = {"el val": "val", "val": "val", "bellús": "bellus", "bellus": "bellus"}


def alias_dimension(spark: SparkSession) -> DataFrame:
    rows = sorted({(a, k) for a, k in RESERVOIR_ALIASES.items()})
    return spark.createDataFrame(rows, "alias string, reservoir_key string")


def scl_dimension(spark: SparkSession) -> DataFrame:
    rows = [(c, es, en) for c, (es, en) in masks.SCL_LABELS.items()]
    return spark.createDataFrame(rows, "code int, label_es string, label_en string")


def index_dimension(spark: SparkSession) -> DataFrame:
    rows = [
        (n, i.name, i.family, i.reservoir)
        for n, i in enumerate(spectral.catalogue())
        if i.reservoir is not None
    ]
    return spark.createDataFrame(rows, "position int, index_name string, family string, reservoir_key string")


def with_reservoir_key(names: DataFrame, column: str = "name") -> DataFrame:
    """Add `reservoir_key` where the name is a known alias, whatever its case and accents."""
    aliases = alias_dimension(names.sparkSession).select(
        text.alias_key(F.col("alias")).alias("_alias"), "reservoir_key"
    ).distinct()
    # The alias list is a constant of this module.
    return names.withColumn("_alias", text.alias_key(F.col(column))).join(F.broadcast(aliases), "_alias", "left").drop("_alias")


def allowed_indices(names: DataFrame, column: str = "name", calibrated_band: str | None = None) -> DataFrame:
    """Indices offered for each reservoir: the general ones, its own, and a calibrated band if any."""
    spark = names.sparkSession
    catalogue = index_dimension(spark)
    if calibrated_band:
        extra = spark.createDataFrame(
            [(10_000, calibrated_band, "calibrated", spectral.EVERY_RESERVOIR)], catalogue.schema
        )
        catalogue = catalogue.unionByName(extra)
    scopes = F.explode(F.array_compact(F.array(F.lit(spectral.EVERY_RESERVOIR), F.col("reservoir_key"))))
    keyed = with_reservoir_key(names, column).withColumn("_scope", scopes)
    return keyed.join(
        F.broadcast(catalogue.withColumnRenamed("reservoir_key", "_scope")), "_scope"
    ).drop("_scope")


def family_members(spark: SparkSession, family: str) -> DataFrame:
    return index_dimension(spark).where(F.col("family") == family)


def reservoir_names(aoi: DataFrame, column: str = "name") -> DataFrame:
    """Distinct names, sorted."""
    return aoi.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def find_reservoir(aoi: DataFrame, wanted: str, column: str = "name") -> DataFrame:
    """Areas whose name equals the wanted one after lower-casing and joining words with `_`."""
    return aoi.where(text.name_key(F.col(column)) == wanted.lower().replace(" ", "_"))
