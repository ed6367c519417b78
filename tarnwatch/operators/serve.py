"""Serving queries over the detection table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import votes
from tarnwatch.functions.geo import water_body_name
from tarnwatch.operators.detect import anomalies


def timeline(detections: DataFrame, digits: int | None = 3) -> DataFrame:
    """Per region and date: mean value, baseline, z and confidence, and the worst severity."""
    means = ["chl_a_value", "chl_a_baseline", "z_score", "confidence"]

    def shown(column):
        mean = F.avg(column)
        return (mean if digits is None else F.bround(mean, digits)).alias(column)

    return (
        detections.groupBy("region_id", "date")
        .agg(*[shown(c) for c in means], F.max(votes.severity_rank(F.col("severity"))).alias("_rank"))
        .withColumn("severity", votes.severity_name(F.col("_rank")))
        .drop("_rank")
    )


def anomaly_features(detections: DataFrame) -> DataFrame:
    """Flagged rows with the properties shown on the map, rounded for display."""
    return anomalies(detections).select(
        "region_id",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "lat",
        "lon",
        "severity",
        F.bround("confidence", 4).alias("confidence"),
        F.bround("chl_a_value", 3).alias("chl_a"),
        F.bround("chl_a_baseline", 3).alias("baseline"),
        F.bround("z_score", 3).alias("z_score"),
        "weather_context",
        "event_id",
    )


def feature_to_event(features: DataFrame) -> DataFrame:
    """A displayed feature back to the event row that a report starts from."""
    return features.select(
        "region_id", "date", "lat", "lon", "severity", "confidence",
        F.col("chl_a").alias("chl_a_value"), F.col("baseline").alias("chl_a_baseline"),
        "z_score", "weather_context",
    )


def severity_breakdown(detections: DataFrame) -> DataFrame:
    return detections.groupBy("region_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def observation_profile(observations: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, value range, dates and cells per region.

    Distinct counts are exact by default; ``approximate`` uses mergeable sketches instead of
    shuffling the distinct pairs.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return observations.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("chl_a").alias("min_chl_a"),
        F.avg("chl_a").alias("mean_chl_a"),
        F.max("chl_a").alias("max_chl_a"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        distinct("date").alias("n_dates"),
        distinct("cell_id").alias("n_cells"),
    )


def detection_profile(detections: DataFrame) -> DataFrame:
    """Rows, anomalies, z range and extent of the timeline per region."""
    flagged = F.col("severity") != "none"
    return detections.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(flagged).alias("n_anomalies"),
        F.min("z_score").alias("min_z"),
        F.max("z_score").alias("max_z"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min("chl_a_value").alias("min_chl_a"),
        F.max("chl_a_value").alias("max_chl_a"),
    )


def timeline_extent(points: DataFrame) -> DataFrame:
    return points.groupBy("region_id").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("severity") != "none").alias("anomaly_dates"),
        F.min("chl_a_value").alias("min_chl_a"),
        F.max("chl_a_value").alias("max_chl_a"),
    )


def normal_band(points: DataFrame, default: float = 8.0, margin: float = 3.0) -> DataFrame:
    """Band around the mean non-zero baseline of a timeline."""
    baseline = F.col("chl_a_baseline")
    mean = F.coalesce(
        F.nullif(F.avg(F.when(baseline != 0, baseline)), F.lit(0.0)), F.lit(default)
    )
    return points.groupBy("region_id").agg(mean.alias("avg_baseline")).select(
        "region_id",
        "avg_baseline",
        F.greatest(F.lit(0.0), F.col("avg_baseline") - margin).alias("normal_low"),
        (F.col("avg_baseline") + margin).alias("normal_high"),
    )


def anomaly_bounds(detections: DataFrame) -> DataFrame:
    """South-west and north-east corner of the anomalies of each region."""
    return anomalies(detections).groupBy("region_id").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"),
        F.max("lon").alias("east"), F.max("lat").alias("north"),
        F.count(F.lit(1)).alias("n_anomalies"),
    )


def dashboard_counters(detections: DataFrame) -> DataFrame:
    """Anomalies and water bodies scanned, over everything."""
    per_region = detections.groupBy("region_id").agg(
        F.count_if(F.col("severity") != "none").alias("n")
    )
    return per_region.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("anomalies"), F.count(F.lit(1)).alias("bodies_scanned")
    )


def recent_regions(regions: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """The most recently stored regions with a display name.

    ``regions`` holds one row per region (see the dataset listing of the observation store) and
    ``names`` maps ``cache_key`` to ``name``.
    """
    newest = regions.orderBy(F.desc("cached_at"), "cache_key").limit(limit)
    return newest.join(names, "cache_key", "left").select(
        F.coalesce("name", water_body_name(F.col("lat"), F.col("lon"))).alias("name"),
        "lat", "lon", "cache_key", "data_points", "cached_at",
    )
