"""Detection: features to votes, severity and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import votes
from tarnwatch.operators.features import MODEL_INPUTS, compute_features
from tarnwatch.operators.forest import isolation_flags
from tarnwatch.operators.spatial import spatial_votes
from tarnwatch.session import stage

IDENTITY = ["region_id", "cell_id", "date", "lat", "lon"]
VOTE_INPUTS = ["chl_a", "chl_a_rolling_mean", "chl_a_zscore", "recent_heavy_rain", "high_wind"]


def ensemble(flagged: DataFrame, exact: bool = False) -> DataFrame:
    """Detection table from features that already carry ``iso_flag`` and ``spatial_flag``."""
    z = F.coalesce(F.col("chl_a_zscore"), F.lit(0.0))
    flags = votes.z_flag(z), F.col("iso_flag"), F.col("spatial_flag")
    return flagged.select(
        "region_id",
        "cell_id",
        "date",
        "lat",
        "lon",
        votes.severity(z, votes.is_anomaly(*flags, exact=exact)).alias("severity"),
        F.least(votes.vote(*flags), F.lit(1.0)).alias("confidence"),
        F.col("chl_a").alias("chl_a_value"),
        F.col("chl_a_rolling_mean").alias("chl_a_baseline"),
        z.alias("z_score"),
        votes.weather_context(F.col("recent_heavy_rain"), F.col("high_wind")).alias("weather_context"),
        votes.event_id(F.col("region_id"), F.col("date"), F.col("lat"), F.col("lon")).alias("event_id"),
    )


def detect(
    features: DataFrame, same_date: bool = False, exact: bool = False, seed: int = 42, **forest
) -> DataFrame:
    """Isolation forest, spatial votes and the ensemble on a feature table.

    Forest, quantile and spatial votes each need the features several times. They are computed
    once into a staged table, with the columns the detector uses.
    """
    needed = [c for c in [*IDENTITY, *MODEL_INPUTS, *VOTE_INPUTS] if c in features.columns]
    stored = stage(features.select(*dict.fromkeys(needed)), "features")
    flagged = isolation_flags(stored, seed=seed, **forest)
    return ensemble(spatial_votes(flagged, same_date=same_date), exact)


def run_pipeline(observations: DataFrame, scope: str = "cell", **options) -> DataFrame:
    """Observations to the detection table, for all regions at once."""
    return detect(compute_features(observations, scope=scope), **options)


def anomalies(detections: DataFrame) -> DataFrame:
    return detections.where(F.col("severity") != "none")
