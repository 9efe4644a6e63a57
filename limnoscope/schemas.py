"""Schemas of the stored tables and of the files that are read."""

from pyspark.sql import types as T

# One image is (reservoir, date, tile): two images may share a date.
SCENE_KEYS = ("reservoir_id", "scene_date", "tile")

# Optical bands that some index reads.
OPTICAL_BANDS = ("b3", "b4", "b5", "b6", "b7", "b8a")

PIXEL = T.StructType(
    [
        T.StructField("pixel_id", T.LongType()),
        T.StructField("reservoir_id", T.IntegerType()),
        T.StructField("scene_date", T.DateType()),
        T.StructField("tile", T.IntegerType()),
        T.StructField("scene_ts", T.TimestampType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("area_m2", T.DoubleType()),
        *[T.StructField(b, T.DoubleType()) for b in OPTICAL_BANDS],
        T.StructField("scl", T.IntegerType()),
        T.StructField("cldprb", T.IntegerType()),
        T.StructField("cloud_meta", T.DoubleType()),
    ]
)

POI_CSV = "embalse string, nombre string, latitud double, longitud double"
VALID_DATE_CSV = "fecha string, nubosidad string"

SENSOR = T.StructType(
    [
        T.StructField("date_time", T.TimestampType()),
        T.StructField("reservoir_code", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("chlorophyll", T.DoubleType()),
        T.StructField("phycocyanin", T.DoubleType()),
        T.StructField("water_temp", T.DoubleType()),
        T.StructField("ph", T.DoubleType()),
        T.StructField("turbidity", T.DoubleType()),
        T.StructField("depth", T.DoubleType()),
    ]
)

# Chlorophyll is not part of the identity of a sensor row.
SENSOR_IDENTITY = (
    "date_time", "reservoir_code", "lon", "lat",
    "phycocyanin", "water_temp", "depth", "ph", "turbidity",
)

MODEL_CONFIG = T.StructType(
    [
        T.StructField("reservoir_id", T.IntegerType()),
        T.StructField("variable", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("band_name", T.StringType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("predictor_set", T.ArrayType(T.StringType())),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("fill_values", T.ArrayType(T.DoubleType())),
    ]
)

GEOJSON = (
    "struct<type:string, features:array<struct<properties:map<string,string>,"
    "geometry:struct<type:string, coordinates:string>>>>"
)
