"""GeoJSON output of anomaly features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPERTIES = ["date", "severity", "confidence", "chl_a", "baseline", "z_score", "weather_context", "event_id"]


def feature(lon: Column, lat: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*PROPERTIES).alias("properties"),
    )


def feature_collections(features: DataFrame) -> DataFrame:
    """Feature collections as JSON text, one per region and date.

    The unit is a key of the data, whatever its size: one date of a region has at most one feature
    per grid cell, so no row grows with the history of a region.
    """
    collected = F.array_sort(
        F.collect_list(F.struct("event_id", feature(F.col("lon"), F.col("lat")).alias("feature")))
    )
    return features.groupBy("region_id", "date").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.to_json(
            F.struct(
                F.lit("FeatureCollection").alias("type"),
                F.transform(collected, lambda f: f["feature"]).alias("features"),
            )
        ).alias("geojson"),
    )


def write_feature_lines(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, in a folder per region."""
    (
        features.select("region_id", F.to_json(feature(F.col("lon"), F.col("lat"))).alias("value"))
        .hint("rebalance", "region_id")
        .write.partitionBy("region_id")
        .mode("overwrite")
        .text(path)
    )
