"""The region dimension, its lookups, and boundary polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.text import zero_pad

DIMENSION_SCHEMA = (
    "county_id string, county_name string, asal_category string, "
    "centroid_lat double, centroid_lon double"
)


def county_dimension(spark: SparkSession) -> DataFrame:
    """47 rows with alternate names and the region each name belongs to."""
    rows = spark.createDataFrame(V.COUNTIES, DIMENSION_SCHEMA)
    regions = spark.createDataFrame(
        list(V.REGIONS.items()), "region string, members array<string>"
    ).select("region", F.explode("members").alias("county_name"))
    spelled = spark.createDataFrame(
        list(V.ALTERNATE_NAMES.items()), "county_name string, alternate_names array<string>"
    )
    return (
        rows.join(F.broadcast(regions), "county_name", "left")
        .join(F.broadcast(spelled), "county_name", "left")
        .select(
            "county_id",
            "county_name",
            F.col("county_name").alias("canonical_name"),
            F.coalesce("alternate_names", F.array().cast("array<string>")).alias("alternate_names"),
            "centroid_lat",
            "centroid_lon",
            "asal_category",
            F.coalesce("region", F.lit("Unknown")).alias("region"),
        )
    )


def list_entities(dim: DataFrame, category: str | None = None) -> DataFrame:
    out = dim if category is None else dim.where(F.col("asal_category") == category)
    return out.orderBy("county_id")


def entity_by_code(dim: DataFrame, code: str) -> DataFrame:
    return dim.where(F.col("county_id") == zero_pad(F.lit(code)))


def insert_absent(new: DataFrame, existing: DataFrame, key: str = "county_id") -> DataFrame:
    """Rows of ``new`` whose key is not stored yet."""
    return new.join(existing.select(key).distinct(), key, "left_anti").select(*new.columns)


def seed_dimension(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Append the absent rows to the stored dimension; returns how many were new."""
    from harbinger.sources.storage import path_exists

    fresh = new
    if path_exists(spark, path):
        fresh = insert_absent(new, spark.read.parquet(path))
    added = fresh.count()
    if added:
        fresh.write.mode("append").parquet(path)
    return added


def read_boundaries(spark: SparkSession, path: str, name: str = "county_name") -> DataFrame:
    """GeoJSON FeatureCollection to ``(name, properties, rings)``.

    Polygons and multi-polygons both come out as an array of rings, each an array of
    ``struct<lon, lat>``.
    """
    schema = (
        "features array<struct<properties: map<string,string>, "
        "geometry: struct<type: string, coordinates: string>>>"
    )
    features = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("f"))
    )
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    points = F.transform(
        rings,
        lambda ring: F.transform(
            ring,
            lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")),
        ),
    )
    return features.select(
        F.col("f.properties")[name].alias("name"),
        F.col("f.properties").alias("properties"),
        points.alias("rings"),
    )


def boundary_points(dim: DataFrame) -> DataFrame:
    """Fallback geometry: one ring of one point per member, at its centroid."""
    point = F.struct(F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    return dim.select(
        F.col("canonical_name").alias("name"),
        F.create_map(F.lit("county_code"), F.col("county_id")).alias("properties"),
        F.array(F.array(point)).alias("rings"),
    )


def load_boundaries(spark: SparkSession, path: str, dim: DataFrame) -> DataFrame:
    """Polygons when the file exists, centroid points otherwise."""
    from harbinger.sources.storage import path_exists

    return read_boundaries(spark, path) if path_exists(spark, path) else boundary_points(dim)


def ring_vertices(boundaries: DataFrame) -> DataFrame:
    """``(name, lon, lat)`` of every ring vertex, the input of contiguity."""
    return boundaries.select("name", F.explode(F.flatten("rings")).alias("v")).select("name", "v.lon", "v.lat")
