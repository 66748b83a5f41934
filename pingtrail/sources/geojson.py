"""Point layers as GeoJSON: one feature per line (newline-delimited, so files split)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def features(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Column ``value``: a GeoJSON feature per row, with a point geometry (WGS84,
    longitude first) and the other columns as properties.  A NULL or non-finite
    coordinate gives a NULL geometry; NULL properties are written as null."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    # abs(x) < infinity is false for infinities and NaN, NULL for NULL
    known = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    point = F.when(known, F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))
    others = [c for c in df.columns if c not in (lon, lat)]
    properties = F.struct(*[F.col(f"`{c}`").alias(c) for c in others]) if others else F.lit(None).cast("map<string,string>")
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude") -> str:
    """Writes :func:`features` of ``df`` as text files."""
    features(df, lon, lat).write.mode("overwrite").text(path)
    return path


def read_geojson(spark: SparkSession, path: str, properties: StructType, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows of features written by :func:`write_geojson`: the declared ``properties``
    and the coordinates (NULL for a NULL geometry)."""
    point = StructType([StructField("type", StringType()), StructField("coordinates", ArrayType(DoubleType()))])
    schema = StructType([StructField("type", StringType()), StructField("geometry", point), StructField("properties", properties)])
    f = spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    return f.select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias(lon),
                    F.get("f.geometry.coordinates", F.lit(1)).alias(lat))
