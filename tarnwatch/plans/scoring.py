"""Queries that score detections and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions.geo import bearing_label, haversine_km
from tarnwatch.operators import detect, features, spatial, validate
from tarnwatch.plans import views
from tarnwatch.plans.registry import query
from tarnwatch.plans.sqlviews import haversine
from tarnwatch.session import stage, staging_dir
from tarnwatch.sources import obstore


@query(f"""
SELECT e.name, e.date, e.lat, e.lon, CASE WHEN e.bloom_confirmed THEN 'bloom' ELSE 'clean' END AS expected, m.worst IS NOT NULL AS detected,
  CASE m.worst WHEN 3 THEN 'critical' WHEN 2 THEN 'severe' WHEN 1 THEN 'moderate' ELSE 'none' END AS severity, COALESCE(m.n, 0) AS n_matches
FROM labelled_events e LEFT JOIN (
  SELECT g.name, COUNT(*) AS n, MAX(CASE d.severity WHEN 'moderate' THEN 1 WHEN 'severe' THEN 2 ELSE 3 END) AS worst
  FROM labelled_events g JOIN (SELECT DISTINCT date, lat, lon, severity FROM anomalies) d ON ABS(date_diff('day', g.date, d.date)) <= 30 AND {haversine('g.lat', 'g.lon', 'd.lat', 'd.lon')} <= 50
  GROUP BY g.name) m ON m.name = e.name""", ("anomalies", "labelled_events"))
def event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events against all anomalies within 30 days and 50 km."""
    return validate.event_matches(
        views.labelled_events(spark, sf_dir), views.detections(spark, sf_dir), same_region=False
    )


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.labelled_events(spark, sf_dir)
    return _scored(events, validate.event_observations(events, views.observations(spark, sf_dir)))


def _scored(events: DataFrame, windowed: DataFrame) -> DataFrame:
    windowed = stage(windowed, "event-windows")
    rows = features.compute_features(validate.with_enough_rows(windowed))
    voted = spatial.spatial_votes(stage(views.with_stand_in(rows), "event-features"))
    detections = detect.ensemble(voted)
    return validate.event_details(events, windowed, detections)


@query("SELECT * FROM event_details", ("event_details",))
def validation_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled events against observations read from the store by place and year."""
    events, rows = views.labelled_events(spark, sf_dir), views.observations(spark, sf_dir)
    store = obstore.open_store(spark, f"{staging_dir(spark)}/observed-{uuid.uuid4().hex}", buckets=16)
    obstore.overwrite_regions(store, rows.withColumn("region_id", F.col("region_id").cast("string")))
    return _scored(events, validate.stored_event_observations(events, store).drop("source", "cloud_fraction"))


@query("SELECT * FROM event_details", ("event_details",))
def validation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled event run through its own window of observations."""
    return _details(spark, sf_dir)


@query("""
SELECT name AS event, CASE WHEN error IS NOT NULL THEN 'Pipeline error: ' || error WHEN data_points = 0 THEN 'No satellite data available for this location/date window'
  WHEN max_z_score < 2 THEN 'Max z-score was ' || printf('%.1f', max_z_score) || ' (below threshold of 2.0). Max chl-a was ' || printf('%.1f', max_chl_a) || ' mg/m³. The bloom may have been too gradual for the rolling-baseline detector, or satellite coverage was sparse during the peak.'
  ELSE 'Z-score reached ' || printf('%.1f', max_z_score) || ' but the ensemble vote (z-score + IsolationForest + spatial) did not reach the 0.65 threshold. This can happen when the bloom is spatially isolated or the multivariate features don''t align.' END AS explanation
FROM event_details WHERE expected = 'bloom' AND NOT detected""", ("event_details",))
def false_negative_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.false_negatives(_details(spark, sf_dir))


@query("""
SELECT COUNT(*) FILTER (WHERE expected = 'bloom' AND detected) AS true_positive, COUNT(*) FILTER (WHERE expected = 'bloom' AND NOT detected) AS false_negative,
  COUNT(*) FILTER (WHERE expected = 'clean' AND NOT detected) AS true_negative, COUNT(*) FILTER (WHERE expected = 'clean' AND detected) AS false_positive
FROM event_details""", ("event_details",))
def validation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.confusion_matrix(_details(spark, sf_dir))


@query()
def validation_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation suite with the isolation forest."""
    events = views.labelled_events(spark, sf_dir)
    return validate.run_validation(events, views.observations(spark, sf_dir))["details"]


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as outcomes: expected where toxic, detected where of low quality."""
    return views.table(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 1, "bloom").otherwise("clean").alias("expected"),
        (F.col("quality") == 0).alias("detected"),
    )


_MATRIX = """
SELECT COUNT(*) FILTER (WHERE toxic = 1 AND quality = 0) AS true_positive, COUNT(*) FILTER (WHERE toxic = 1 AND quality <> 0) AS false_negative,
  COUNT(*) FILTER (WHERE toxic <> 1 AND quality <> 0) AS true_negative, COUNT(*) FILTER (WHERE toxic <> 1 AND quality = 0) AS false_positive FROM labels"""


@query(_MATRIX)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.confusion_matrix(_rated(spark, sf_dir))


@query(f"""
SELECT ROUND((tp + tn) / (tp + fn + tn + fp), 4) AS accuracy, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0e0), 4) AS precision,
  ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0e0), 4) AS recall, ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0e0), 4) AS f1_score
FROM (SELECT CAST(true_positive AS DOUBLE) AS tp, CAST(false_negative AS DOUBLE) AS fn, CAST(true_negative AS DOUBLE) AS tn, CAST(false_positive AS DOUBLE) AS fp FROM ({_MATRIX}) m) c""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.metrics(validate.confusion_matrix(_rated(spark, sf_dir)))


@query(f"""
SELECT event_id, ROUND({haversine('41.65', '-83.0', 'lat', 'lon')}, 6) AS km,
  list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(ROUND_EVEN(((DEGREES(ATAN2(SIN(RADIANS(lon + 83)) * COS(RADIANS(lat)),
    COS(RADIANS(4165e-2)) * SIN(RADIANS(lat)) - SIN(RADIANS(4165e-2)) * COS(RADIANS(lat)) * COS(RADIANS(lon + 83)))) + 36e1) % 36e1) / 45e0, 0) AS INTEGER) % 8 + 1) AS direction
FROM anomaly_events""".replace("41.65", "4165e-2").replace("-83.0", "-83e0"), ("anomaly_events",))
def distance_and_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and direction of every event from one fixed point."""
    here = F.lit(41.65), F.lit(-83.0)
    there = F.col("lat"), F.col("lon")
    return views.anomaly_events(spark, sf_dir).select(
        "event_id", F.round(haversine_km(*here, *there), 6).alias("km"), bearing_label(*here, *there).alias("direction")
    )
