"""Queries over the observation series: clean-up, features, votes and serving."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions import climatology, geo, votes
from tarnwatch.operators import detect, features as feats, forest, serve, spatial
from tarnwatch.plans import views
from tarnwatch.plans.registry import query
from tarnwatch.session import staging_dir
from tarnwatch.sources import geojson, gridded


# Means and differences of chl_a are exact in both engines and compared as they are.
INEXACT = ["chl_a_rolling_std", "chl_a_zscore"]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


KEYS = ["region_id", "cell_id", "date"]


@query("""
SELECT region_id, cell_id, date, lat, lon, chl_a, ROUND(filled, 6) AS turbidity
FROM (SELECT *, LAST_VALUE(turbidity IGNORE NULLS) OVER (PARTITION BY region_id, cell_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS filled FROM cleaned) c
WHERE filled IS NOT NULL""", ("cleaned",))
def observations_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows to typed, plausible, gap-filled observations."""
    raw = gridded.normalize_headers(views.raw_observations(spark, sf_dir))
    filled = gridded.fill_missing(gridded.clean(raw), ["turbidity"])
    return rounded(filled.select(*KEYS, "lat", "lon", "chl_a", "turbidity"), "turbidity")


@query("""
SELECT region_id, cell_id, date, ROUND(filled, 6) AS turbidity
FROM (SELECT *, LAST_VALUE(turbidity IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS filled FROM cleaned) c
WHERE filled IS NOT NULL""", ("cleaned",))
def observations_filled_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap fill along whole regions, as in a file read front to back."""
    raw = gridded.normalize_headers(views.raw_observations(spark, sf_dir))
    filled = gridded.fill_missing(gridded.clean(raw), ["turbidity"], scope="region")
    return rounded(filled.select(*KEYS, "turbidity"), "turbidity")


@query("SELECT date, lat, lon, chl_a FROM cleaned", ("cleaned",))
def gridded_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as CSV with a units row, then read back and cleaned."""
    columns = ["time", "latitude", "longitude", "chlorophyll"]
    units = spark.createDataFrame([("UTC", "degrees_north", "degrees_east", "mg m-3")], columns)
    path = f"{staging_dir(spark)}/gridded-{uuid.uuid4().hex}"
    rows = views.raw_observations(spark, sf_dir).select(*columns)
    units.unionByName(rows).write.option("header", True).csv(path)
    return gridded.read_gridded_csv(spark, path).select("date", "lat", "lon", "chl_a")


@query("SELECT CAST(region_id AS VARCHAR) AS region_id, date, lat, lon, chl_a, ROUND(turbidity, 6) AS turbidity FROM observations WHERE date >= DATE '1997-01-01' AND date <= DATE '1999-06-30'",
       ("observations",))
def observation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations stored by region and year, then a date range read back."""
    path = f"{staging_dir(spark)}/store-{uuid.uuid4().hex}"
    missing = [F.lit(None).cast("double").alias("cloud_fraction"), F.lit("lineitem").alias("source")]
    rows = views.observations(spark, sf_dir).select("*", *missing).drop("cell_id")
    gridded.write_observations(rows.withColumn("region_id", F.col("region_id").cast("string")), path)
    kept = gridded.read_observations(spark, path, start="1997-01-01", end="1999-06-30")
    return rounded(kept.select("region_id", "date", "lat", "lon", "chl_a", "turbidity"), "turbidity")


@query("""
SELECT l_orderkey AS region_id, l_returnflag AS source, l_linenumber AS line, l_quantity AS quantity
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS p,
  MIN(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) l
WHERE p = best""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three sources the first that has rows, per region (here: per order)."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("region_id"), F.col("l_returnflag").alias("source"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
    )
    sources = [lines.where(F.col("source") == flag) for flag in ("A", "N", "R")]
    return gridded.first_available(sources).drop("priority")


@query("""
SELECT region_id, cell_id, date, lat, lon, chl_a FROM observations
WHERE lat BETWEEN 302e-1 - 1e-1 AND 302e-1 + 1e-1 AND lon BETWEEN -798e-1 - 1e-1 AND -798e-1 + 1e-1 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
       ("observations",))
def bbox_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gridded.in_box(views.observations(spark, sf_dir), 30.2, -79.8, 0.1, "1996-01-01", "1998-12-31")
    return kept.select(*KEYS, "lat", "lon", "chl_a")


@query("""
SELECT region_id, cell_id, date, chl_a_rolling_mean, ROUND(chl_a_rolling_std, 6) AS chl_a_rolling_std,
  ROUND(chl_a_zscore, 6) AS chl_a_zscore, chl_a_delta_1w, chl_a_delta_2w
FROM rolled""", ("rolled",))
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = feats.rolling_features(views.observations(spark, sf_dir))
    return rounded(rolled.select(*KEYS, *feats.ROLLING), *INEXACT)


@query("""
SELECT region_id, cell_id, date, chl_a_rolling_mean, ROUND(chl_a_rolling_std, 6) AS chl_a_rolling_std,
  ROUND(chl_a_zscore, 6) AS chl_a_zscore, chl_a_delta_1w, chl_a_delta_2w
FROM rolled""", ("rolled",))
def rolling_features_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features with every cell cut into years, as for cells without a bound."""
    rolled = feats.rolling_features(views.observations(spark, sf_dir), slice_by=F.year("date"))
    return rounded(rolled.select(*KEYS, *feats.ROLLING), *INEXACT)


@query("SELECT region_id, cell_id, date, chl_a_seasonal_residual FROM rolled", ("rolled",))
def seasonal_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feats.seasonal_residual(views.observations(spark, sf_dir))
    return rows.select(*KEYS, "chl_a_seasonal_residual")


@query("SELECT region_id, cell_id, CAST(EXTRACT(WEEK FROM date) AS INTEGER) AS iso_week, SUM(chl_a) / COUNT(chl_a) AS seasonal_mean, COUNT(*) AS n FROM observations GROUP BY ALL",
       ("observations",))
def seasonal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feats.seasonal_means(views.observations(spark, sf_dir))


FEATURE_COLUMNS = [*feats.ROLLING, "chl_a_seasonal_residual"]
FEATURE_SQL = ", ".join(f"ROUND({c}, 6) AS {c}" if c in INEXACT else c for c in FEATURE_COLUMNS)


@query(f"SELECT region_id, cell_id, date, {FEATURE_SQL}, recent_heavy_rain, high_wind FROM features", ("features",))
def ffill_features_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.features(spark, sf_dir)
    return rounded(rows.select(*KEYS, *FEATURE_COLUMNS, "recent_heavy_rain", "high_wind"), *INEXACT)


_FILLED = ", ".join(
    f"LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY first_date, first_ordinal, date ROWS UNBOUNDED PRECEDING) AS {c}"
    for c in feats.ROLLING
)


@query(f"""
SELECT region_id, cell_id, date, {FEATURE_SQL} FROM (
  SELECT region_id, cell_id, date, chl_a_seasonal_residual, {_FILLED} FROM (
    SELECT *, FIRST_VALUE(date) OVER (PARTITION BY region_id, cell_id ORDER BY date) AS first_date,
      FIRST_VALUE(ordinal) OVER (PARTITION BY region_id, cell_id ORDER BY date) AS first_ordinal FROM rolled) r) f
WHERE chl_a_rolling_std IS NOT NULL AND chl_a_delta_2w IS NOT NULL AND chl_a_zscore IS NOT NULL AND chl_a_delta_1w IS NOT NULL""", ("rolled",))
def ffill_features_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.with_arrival(views.observations(spark, sf_dir))
    filled = feats.compute_features(rows, scope="region")
    return rounded(filled.select(*KEYS, *FEATURE_COLUMNS), *INEXACT)


@query("""
SELECT region_id, cell_id, date, recent_heavy_rain, high_wind,
  CASE WHEN recent_heavy_rain <> 0 THEN 'post_rainfall_runoff' WHEN high_wind <> 0 THEN 'wind_driven_resuspension' ELSE 'calm_conditions' END AS weather_context
FROM rolled""", ("rolled",))
def weather_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feats.weather_flags(views.observations(spark, sf_dir))
    label = votes.weather_context(F.col("recent_heavy_rain"), F.col("high_wind"))
    return rows.select(*KEYS, "recent_heavy_rain", "high_wind", label.alias("weather_context"))


@query("""
SELECT region_id, cell_id, date, baseline, amplitude,
  ROUND(chl_a - baseline * (1e0 + amplitude * (EXP(-((adj - 120) * (adj - 120)) / 32e2) + 4e-1 * EXP(-((adj - 280) * (adj - 280)) / 18e2))), 6) AS residual
FROM (
  SELECT *, (CAST(EXTRACT(DOY FROM date) AS INTEGER) + CASE WHEN site_lat >= 0 THEN 0 ELSE 182 END) % 365 AS adj,
    CASE WHEN ABS(site_lat) < 15 THEN 8e0 WHEN ABS(site_lat) < 30 THEN 55e-1 WHEN ABS(site_lat) < 50 THEN 4e0 WHEN ABS(site_lat) < 65 THEN 25e-1 ELSE 15e-1 END AS baseline,
    CASE WHEN ABS(site_lat) < 15 THEN 15e-2 WHEN ABS(site_lat) < 30 THEN 3e-1 WHEN ABS(site_lat) < 50 THEN 5e-1 ELSE 35e-2 END AS amplitude
  FROM (SELECT *, (cell_id % 35) * 5e0 - 85e0 AS site_lat FROM observations) s) b""", ("observations",))
def climatology_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed minus expected value, with the cells spread over all latitudes."""
    rows = views.observations(spark, sf_dir).withColumn("site_lat", (F.col("cell_id") % 35) * 5e0 - 85e0)
    lat = F.col("site_lat")
    residual = climatology.climatology_residual(F.col("chl_a"), lat, F.col("date"))
    return rows.select(
        *KEYS, climatology.baseline_chl(lat).alias("baseline"),
        climatology.seasonal_amplitude(lat).alias("amplitude"), F.round(residual, 6).alias("residual"),
    )


@query("SELECT region_id, cell_id, date, spatial_flag FROM voted", ("voted",))
def spatial_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_votes(views.stored_features(spark, sf_dir)).select(*KEYS, "spatial_flag")


def _same_date_sql() -> str:
    from tarnwatch.plans.sqlviews import spatial as spatial_sql

    return f"SELECT region_id, cell_id, date, spatial_flag FROM ({spatial_sql('features', same_date=True)}) s"


@query(_same_date_sql(), ("features",))
def spatial_votes_same_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.stored_features(spark, sf_dir)
    return spatial.spatial_votes(rows, same_date=True).select(*KEYS, "spatial_flag")


DETECTION_SQL = """
SELECT region_id, cell_id, date, severity, ROUND(confidence, 6) AS confidence, chl_a_value, chl_a_baseline,
  ROUND(z_score, 6) AS z_score, weather_context, event_id FROM {view}"""
DETECTION_COLUMNS = [
    *KEYS, "severity", "confidence", "chl_a_value", "chl_a_baseline", "z_score", "weather_context", "event_id",
]


@query(DETECTION_SQL.format(view="detections"), ("detections",))
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir).select(*DETECTION_COLUMNS)
    return rounded(rows, "confidence", "z_score")


@query(DETECTION_SQL.format(view="detections_exact"), ("detections_exact",))
def ensemble_vote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.detections(spark, sf_dir, exact=True).select(*DETECTION_COLUMNS)
    return rounded(rows, "confidence", "z_score")


@query()
def iforest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest.isolation_flags(views.stored_features(spark, sf_dir))
    return rows.select(*KEYS, "iso_score", "iso_flag")


@query()
def detect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection with the forest instead of the stand-in rule."""
    return detect.detect(views.features(spark, sf_dir)).select(*DETECTION_COLUMNS)


MEANS = ["chl_a_value", "chl_a_baseline", "z_score", "confidence"]


@query("SELECT region_id, date, ROUND(chl_a_value, 6) AS chl_a_value, ROUND(chl_a_baseline, 6) AS chl_a_baseline, ROUND(z_score, 6) AS z_score, ROUND(confidence, 6) AS confidence, severity FROM timeline_points",
       ("timeline_points",))
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = serve.timeline(views.detections(spark, sf_dir), digits=None)
    return rounded(points, *MEANS).orderBy("region_id", "date")


@query("""
SELECT region_id, strftime(date, '%Y-%m-%d') AS date, lat, lon, severity, ROUND(confidence, 4) AS confidence, ROUND_EVEN(chl_a_value, 3) AS chl_a,
  ROUND_EVEN(chl_a_baseline, 3) AS baseline, ROUND_EVEN(z_score, 3) AS z_score, weather_context, event_id FROM anomalies""", ("anomalies",))
def anomaly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.anomaly_features(views.detections(spark, sf_dir))


@query("""
SELECT region_id, strftime(date, '%Y-%m-%d') AS date, lat, lon, severity, ROUND(confidence, 4) AS confidence, ROUND_EVEN(chl_a_value, 3) AS chl_a_value,
  ROUND_EVEN(chl_a_baseline, 3) AS chl_a_baseline, ROUND_EVEN(z_score, 3) AS z_score, weather_context FROM anomalies""", ("anomalies",))
def feature_to_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.feature_to_event(serve.anomaly_features(views.detections(spark, sf_dir)))


@query()
def geojson_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies as GeoJSON documents."""
    return geojson.feature_collections(serve.anomaly_features(views.detections(spark, sf_dir)))


@query("SELECT region_id, severity, COUNT(*) AS n FROM detections GROUP BY ALL", ("detections",))
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.severity_breakdown(views.detections(spark, sf_dir))


@query("""
SELECT region_id, COUNT(*) AS n_rows, MIN(chl_a) AS min_chl_a, SUM(chl_a) / COUNT(chl_a) AS mean_chl_a, MAX(chl_a) AS max_chl_a,
  MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT date) AS n_dates, COUNT(DISTINCT cell_id) AS n_cells
FROM observations GROUP BY region_id""", ("observations",))
def pipeline_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.observation_profile(views.observations(spark, sf_dir))


@query("""
SELECT region_id, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE severity <> 'none') AS n_anomalies, ROUND(MIN(z_score), 6) AS min_z, ROUND(MAX(z_score), 6) AS max_z,
  MIN(date) AS first_date, MAX(date) AS last_date, MIN(chl_a_value) AS min_chl_a, MAX(chl_a_value) AS max_chl_a
FROM detections GROUP BY region_id""", ("detections",))
def detection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serve.detection_profile(views.detections(spark, sf_dir)), "min_z", "max_z")


@query("""
SELECT region_id, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) FILTER (WHERE severity <> 'none') AS anomaly_dates,
  ROUND(MIN(chl_a_value), 6) AS min_chl_a, ROUND(MAX(chl_a_value), 6) AS max_chl_a FROM timeline_points GROUP BY region_id""", ("timeline_points",))
def timeline_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = serve.timeline(views.detections(spark, sf_dir), digits=None)
    return rounded(serve.timeline_extent(points), "min_chl_a", "max_chl_a")


@query("""
SELECT region_id, ROUND(b, 6) AS avg_baseline, ROUND(GREATEST(0e0, b - 3), 6) AS normal_low, ROUND(b + 3, 6) AS normal_high
FROM (SELECT region_id, COALESCE(AVG(CASE WHEN chl_a_baseline <> 0 THEN chl_a_baseline END), 8e0) AS b FROM timeline_points GROUP BY region_id) p""",
       ("timeline_points",))
def normal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = serve.timeline(views.detections(spark, sf_dir), digits=None)
    return rounded(serve.normal_band(points), "avg_baseline", "normal_low", "normal_high")


@query("SELECT region_id, MIN(lon) AS west, MIN(lat) AS south, MAX(lon) AS east, MAX(lat) AS north, COUNT(*) AS n_anomalies FROM anomalies GROUP BY region_id",
       ("anomalies",))
def anomaly_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.anomaly_bounds(views.detections(spark, sf_dir))


@query("SELECT COUNT(*) FILTER (WHERE severity <> 'none') AS anomalies, COUNT(DISTINCT region_id) AS bodies_scanned FROM detections", ("detections",))
def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.dashboard_counters(views.detections(spark, sf_dir))


@query("""
SELECT COALESCE(n.name, 'Water body at ' || printf('%.2f', r.lat) || ', ' || printf('%.2f', r.lon)) AS name, r.lat, r.lon, r.cache_key, r.data_points, r.cached_at
FROM (SELECT *, printf('%.2f', lat) || '_' || printf('%.2f', lon) AS cache_key FROM (
  SELECT region_id, MIN(lat) AS lat, MIN(lon) AS lon, COUNT(*) AS data_points, MAX(date) AS cached_at FROM observations GROUP BY region_id) o
  ORDER BY cached_at DESC, cache_key LIMIT 20) r
LEFT JOIN (SELECT n_name AS name, printf('%.2f', 3e1 + n_nationkey * 1e1) || '_-80.00' AS cache_key FROM nation) n
  ON n.cache_key = r.cache_key""", ("observations",))
def recent_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest regions; some have a name given by an earlier search."""
    searched = F.lit(3e1) + F.col("n_nationkey") * 1e1
    names = views.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), geo.location_key(searched, F.lit(-80.0)).alias("cache_key")
    )
    return serve.recent_regions(gridded.regions_of(views.observations(spark, sf_dir)), names)
