"""Scoring detections against labelled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions import votes
from tarnwatch.functions.text import fixed
from tarnwatch.operators.carry import carry_forward
from tarnwatch.operators.detect import anomalies, run_pipeline
from tarnwatch.operators.nearby import within_box, within_radius
from tarnwatch.schemas import NUMERIC_INPUTS
from tarnwatch.session import stage
from tarnwatch.sources import obstore
from tarnwatch.sources.buckets import BucketStore

MATCH_DAYS = 30
MATCH_KM = 50.0
WINDOW_DAYS = 60
MIN_ROWS = 5

# Documented events (name, lat, lon, date, bloom confirmed).
DOCUMENTED_EVENTS = [
    ("Lake Erie — Toledo water crisis", 41.65, -83.0, "2014-08-02", True),
    ("Lake Erie — Largest recorded bloom 5000 km²", 41.5, -82.8, "2011-10-01", True),
    ("Spencer Gulf — Karenia bloom", -34.5, 137.0, "2024-09-15", True),
    ("Lake Tai — Wuxi water crisis", 31.2, 120.2, "2007-08-01", True),
    ("Lake Okeechobee — State of emergency", 26.95, -80.83, "2018-07-15", True),
    ("Chesapeake Bay — Record dead zone", 37.8, -76.1, "2019-08-15", True),
    ("Gulf of Mexico — Largest dead zone 22,720 km²", 29.0, -89.5, "2017-07-15", True),
    ("Baltic Sea — Massive cyanobacteria bloom", 57.5, 19.5, "2019-07-15", True),
    ("Lake Winnipeg — Algal bloom", 51.0, -96.8, "2017-09-15", True),
    ("Seto Inland Sea Japan — Red tide", 34.3, 133.5, "2022-08-15", True),
    ("Lake Erie — Winter baseline (no bloom)", 41.65, -83.0, "2014-02-15", False),
    ("Spencer Gulf — Pre-bloom baseline", -34.5, 137.0, "2023-02-15", False),
    ("Lake Tai — Winter low activity", 31.2, 120.2, "2020-01-15", False),
    ("Lake Okeechobee — Dry season", 26.95, -80.83, "2019-12-15", False),
    ("Chesapeake Bay — Winter baseline", 37.8, -76.1, "2020-02-15", False),
]


def documented_events(spark) -> DataFrame:
    rows = spark.createDataFrame(
        DOCUMENTED_EVENTS, "name string, lat double, lon double, date string, bloom_confirmed boolean"
    )
    return rows.withColumn("date", F.to_date("date"))


def event_observations(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations within half a degree and 60 days of each event, one region per event.

    Stored regions overlap, so a cell may be stored twice for a date; the row that comes first in
    the order of its values counts.
    """
    requests = events.select(
        F.col("name").alias("_event"), F.col("lat").alias("request_lat"),
        F.col("lon").alias("request_lon"), F.col("date").alias("request_date"),
    )
    windowed = within_box(observations.drop("region_id"), requests, 0.5, WINDOW_DAYS)
    return _one_per_cell(windowed.withColumnRenamed("_event", "region_id").drop("request_lat", "request_lon", "request_date"))


def stored_event_observations(events: DataFrame, store: BucketStore) -> DataFrame:
    """As :func:`event_observations`, reading only the store's files for the events' places and years."""
    windowed = obstore.around_events(store, events, 0.5, WINDOW_DAYS).drop("region_id", "event_lat", "event_lon", "event_date")
    return _one_per_cell(windowed.withColumnRenamed("event", "region_id"))


def _one_per_cell(windowed: DataFrame) -> DataFrame:
    key = ["region_id", "cell_id", "date"]
    first = Window.partitionBy(*key).orderBy(*(c for c in sorted(windowed.columns) if c not in key))
    return windowed.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def normalised(windowed: DataFrame) -> DataFrame:
    """Numeric inputs filled from the row before within the event; rows that still lack one go."""
    inputs = [c for c in NUMERIC_INPUTS if c in windowed.columns]
    return carry_forward(windowed, ["region_id"], ["date", "cell_id"], inputs).dropna(subset=inputs)


def with_enough_rows(windowed: DataFrame) -> DataFrame:
    """Normalised rows of the events that have at least five of them."""
    windowed = normalised(windowed)
    counts = windowed.groupBy("region_id").agg(F.count(F.lit(1)).alias("_n"))
    return windowed.join(counts.where(F.col("_n") >= MIN_ROWS).drop("_n"), "region_id")


def event_matches(events: DataFrame, detections: DataFrame, same_region: bool = True) -> DataFrame:
    """What the detections say about each event.

    ``events`` has ``name, lat, lon, date, bloom_confirmed``; with ``same_region`` the region of
    the detections is the event's name. An event counts as detected if an anomaly lies within 30
    days and 50 km; events without any stay in the result.
    """
    flagged = anomalies(detections).select("region_id", "date", "lat", "lon", "severity")
    probe = events.select(
        "name", F.col("lat").alias("probe_lat"), F.col("lon").alias("probe_lon"), F.col("date").alias("event_date")
    )
    keys = []
    if same_region:
        flagged = flagged.withColumnRenamed("region_id", "name")
        keys = ["name"]
    # Repeated anomalies at one place and date say the same: one row per place, date and severity.
    distinct = flagged.select(*keys, "date", "lat", "lon", "severity").distinct()
    worst = (
        within_radius(probe, distinct, MATCH_KM, keys)
        .where(F.abs(F.datediff("date", "event_date")) <= MATCH_DAYS)
        .groupBy("name")
        .agg(F.max(votes.severity_rank(F.col("severity"))).alias("_rank"), F.count(F.lit(1)).alias("n_matches"))
    )
    return events.join(worst, "name", "left").select(
        "name", "date", "lat", "lon",
        F.when(F.col("bloom_confirmed"), "bloom").otherwise("clean").alias("expected"),
        F.col("_rank").isNotNull().alias("detected"),
        votes.severity_name(F.coalesce("_rank", F.lit(0))).alias("severity"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def event_maxima(detections: DataFrame, key: str = "region_id") -> DataFrame:
    return detections.groupBy(F.col(key).alias("name")).agg(
        F.bround(F.max("chl_a_value"), 2).alias("max_chl_a"),
        F.bround(F.max(F.abs("z_score")), 2).alias("max_z_score"),
    )


def event_details(events: DataFrame, windowed: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per event with maxima, row count, match and error.

    ``data_points`` counts the rows found, the guard those left after normalising.
    """
    points = windowed.groupBy(F.col("region_id").alias("name")).agg(F.count(F.lit(1)).alias("data_points"))
    usable = normalised(windowed).groupBy(F.col("region_id").alias("name")).agg(F.count(F.lit(1)).alias("_usable"))
    n, left = F.coalesce("data_points", F.lit(0)), F.coalesce("_usable", F.lit(0))
    error = (
        F.when(n == 0, "No satellite data available for this location/date")
        .when(left < MIN_ROWS, F.concat(F.lit("Insufficient data: only "), left.cast("string"), F.lit(" points")))
        .when(F.col("max_z_score").isNull(), "Feature engineering produced empty result")
    )
    joined = (
        event_matches(events, detections)
        .join(points, "name", "left")
        .join(usable, "name", "left")
        .join(event_maxima(detections), "name", "left")
    )
    return joined.select(
        "name", "date", "lat", "lon", "expected", "detected", "severity",
        F.coalesce("max_z_score", F.lit(0.0)).alias("max_z_score"),
        F.coalesce("max_chl_a", F.lit(0.0)).alias("max_chl_a"),
        n.alias("data_points"),
        passed(F.col("expected"), F.col("detected")).alias("passed"),
        error.alias("error"),
    )


def passed(expected: Column, detected: Column) -> Column:
    return (expected == "bloom") == detected


def confusion_matrix(details: DataFrame, *by: str) -> DataFrame:
    """Counts of the four outcomes; an event that failed counts as not detected."""
    bloom, hit = F.col("expected") == "bloom", F.col("detected")
    return details.groupBy(*by).agg(
        F.count_if(bloom & hit).alias("true_positive"),
        F.count_if(bloom & ~hit).alias("false_negative"),
        F.count_if(~bloom & ~hit).alias("true_negative"),
        F.count_if(~bloom & hit).alias("false_positive"),
    )


def metrics(matrix: DataFrame, *by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 to four decimals, 0 where undefined."""
    tp, fn, tn, fp = (
        F.col(c).cast("double")
        for c in ("true_positive", "false_negative", "true_negative", "false_positive")
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = {
        "accuracy": ratio(tp + tn, tp + fn + tn + fp),
        "precision": precision,
        "recall": recall,
        "f1_score": ratio(2 * precision * recall, precision + recall),
    }
    return matrix.select(*by, *[F.bround(v, 4).alias(k) for k, v in values.items()])


def false_negatives(details: DataFrame) -> DataFrame:
    """Confirmed events that were not detected, with the likely reason."""
    z, chl = F.col("max_z_score"), F.col("max_chl_a")
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Pipeline error: "), "error"))
        .when(F.col("data_points") == 0, "No satellite data available for this location/date window")
        .when(z < 2.0, F.concat(
            F.lit("Max z-score was "), fixed(z, 1), F.lit(" (below threshold of 2.0). Max chl-a was "),
            fixed(chl, 1), F.lit(" mg/m³. The bloom may have been too gradual for the rolling-baseline "
                                 "detector, or satellite coverage was sparse during the peak."),
        ))
        .otherwise(F.concat(
            F.lit("Z-score reached "), fixed(z, 1), F.lit(" but the ensemble vote (z-score + IsolationForest "
            "+ spatial) did not reach the 0.65 threshold. This can happen when the bloom is spatially "
            "isolated or the multivariate features don't align."),
        ))
    )
    return details.where((F.col("expected") == "bloom") & ~F.col("detected")).select(
        F.col("name").alias("event"), reason.alias("explanation")
    )


def run_validation(events: DataFrame, observations: DataFrame | BucketStore, **options) -> dict[str, DataFrame]:
    """The validation suite: window, features, detection and match for all events in one job.

    ``observations`` are a table, or a store of which only the events' places and years are read.
    """
    find = stored_event_observations if isinstance(observations, BucketStore) else event_observations
    windowed = stage(find(events, observations), "event-windows")
    detections = stage(run_pipeline(with_enough_rows(windowed), **options), "event-detections")
    details = event_details(events, windowed, detections)
    matrix = confusion_matrix(details)
    return {
        "details": details,
        "confusion_matrix": matrix,
        "metrics": metrics(matrix),
        "false_negatives": false_negatives(details),
    }
