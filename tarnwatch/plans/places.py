"""Queries around places: lookups, catalogs, facilities, reports and search input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch import schemas
from tarnwatch.functions import geo, text
from tarnwatch.operators import detect, facilities, modeloutput, nearby, report
from tarnwatch.plans import views
from tarnwatch.plans.registry import query
from tarnwatch.plans.sqlviews import label
from tarnwatch.session import stage
from tarnwatch.sources import catalogs


def context_text(tags) -> F.Column:
    """Tags as ``key=value`` in key order, for comparison."""
    entries = F.array_sort(F.map_entries(tags))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("""
SELECT request_id, cache_key, lat, lon, exact FROM (
  SELECT r.request_id, k.cache_key, k.lat, k.lon, r.request_key = k.cache_key AS exact,
    ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN r.request_key = k.cache_key THEN 0 ELSE 1 END,
      (k.lat - r.lat) * (k.lat - r.lat) + (k.lon - r.lon) * (k.lon - r.lon), k.cache_key) AS rn
  FROM (SELECT *, printf('%.2f', lat) || '_' || printf('%.2f', lon) AS request_key FROM (
      SELECT c_custkey AS request_id, ROUND(3e1 + (c_custkey % 97) * 7e-3 + (CAST(FLOOR(c_custkey / 15e2) AS BIGINT) % 12) * 5e0, 4) AS lat,
        ROUND(-8e1 + (c_custkey % 89) * 7e-3, 4) AS lon FROM customer) c) r
  JOIN (SELECT DISTINCT printf('%.2f', lat) || '_' || printf('%.2f', lon) AS cache_key, lat, lon FROM (
      SELECT ROUND(3e1 + (s_suppkey % 10) * 5e-2 + (CAST(FLOOR(s_suppkey / 1e2) AS BIGINT) % 12) * 5e0, 2) AS lat,
        ROUND(-8e1 + (CAST(FLOOR(s_suppkey / 1e1) AS BIGINT) % 10) * 5e-2, 2) AS lon FROM supplier) s) k
    ON ABS(k.lat - r.lat) <= 1e-1 AND ABS(k.lon - r.lon) <= 1e-1) m
WHERE rn = 1""")
def nearby_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each requested point the stored location that can serve it."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    requests = views.table(spark, sf_dir, "customer").select(
        c.alias("request_id"),
        F.round(3e1 + (c % 97) * 7e-3 + (F.floor(c / 15e2) % 12) * 5e0, 4).alias("request_lat"),
        F.round(-8e1 + (c % 89) * 7e-3, 4).alias("request_lon"),
    )
    requests = requests.withColumn("request_key", geo.location_key(F.col("request_lat"), F.col("request_lon")))
    stored = views.table(spark, sf_dir, "supplier").select(
        F.round(3e1 + (s % 10) * 5e-2 + (F.floor(s / 1e2) % 12) * 5e0, 2).alias("lat"),
        F.round(-8e1 + (F.floor(s / 1e1) % 10) * 5e-2, 2).alias("lon"),
    )
    stored = stored.withColumn("cache_key", geo.location_key(F.col("lat"), F.col("lon")))
    return nearby.nearby_keys(requests, stored)


@query(f"""
SELECT event_id, printf('%.2f', lat) || '_' || printf('%.2f', lon) AS id,
  CASE WHEN event_id % 3 = 0 THEN 'Water body at ' || printf('%.2f', lat) || ', ' || printf('%.2f', lon) ELSE region_id END AS name,
  'Unknown' AS country, lon - 5e-1 AS min_lon, lat + 5e-1 AS max_lat, 'Sentinel-3 OLCI chlorophyll monitoring at ' || {label()} AS description
FROM anomaly_events""", ("anomaly_events",))
def region_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.anomaly_events(spark, sf_dir)
    name = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("region_id"))
    region = geo.region_struct(F.col("lat"), F.col("lon"), name, F.lit(""))
    return events.select("event_id", region.alias("r")).select(
        "event_id", "r.id", "r.name", "r.country", F.col("r.bbox")[0].alias("min_lon"),
        F.col("r.bbox")[3].alias("max_lat"), "r.description",
    )


CATALOG_DATES = """
a AS (SELECT DISTINCT region_id, CAST(SUBSTRING(product_time, 1, 10) AS DATE) AS date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY product_time DESC, product_id DESC) AS rn FROM catalog_a) x WHERE rn <= 200),
b AS (SELECT DISTINCT region_id, CAST(SUBSTRING(product_time, 1, 10) AS DATE) AS date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY product_time DESC, product_id DESC) AS rn FROM catalog_b) x WHERE rn <= 100),
dates AS (SELECT * FROM a UNION SELECT * FROM b WHERE region_id NOT IN (SELECT region_id FROM a GROUP BY region_id HAVING COUNT(*) >= 10))"""


@query(f"""
, {CATALOG_DATES.strip()}
SELECT region_id, CAST(EXTRACT(ISOYEAR FROM date) AS INTEGER) AS iso_year, CAST(EXTRACT(WEEK FROM date) AS INTEGER) AS iso_week, MIN(date) AS date
FROM dates GROUP BY ALL""", ("catalog_a", "catalog_b"))
def catalog_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dates of both catalogs, one per ISO week."""
    return catalogs.weekly_dates(catalogs.product_dates(*views.product_catalogs(spark, sf_dir)))


RECENT = "1999-08-02"
_EXISTS = f"""
SELECT c_custkey AS region_id, c_name AS name FROM customer WHERE c_custkey {{negate}} IN (
  SELECT region_id FROM catalog_a WHERE product_time >= '{RECENT}' UNION SELECT region_id FROM catalog_b WHERE product_time >= '{RECENT}')"""


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    regions = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("region_id"), F.col("c_name").alias("name")
    )
    recent = F.col("product_time") >= RECENT
    return regions, *[c.where(recent) for c in views.product_catalogs(spark, sf_dir)]


@query(_EXISTS.format(negate=""), ("catalog_a", "catalog_b"))
def catalog_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.regions_with_products(*_searched(spark, sf_dir))


@query(_EXISTS.format(negate="NOT"), ("catalog_a", "catalog_b"))
def catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.regions_without_products(*_searched(spark, sf_dir))


@query("""
SELECT element_id, list_aggregate(groups, 'string_agg', ',') AS groups, fname AS name, type, source_category, lat, lon, tag_text AS tags
FROM facilities WHERE len(groups) > 0""", ("facilities",))
def facility_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facilities.classify(views.facility_elements(spark, sf_dir))
    return rows.withColumns(
        {"tags": context_text(F.col("tags")), "groups": F.array_join(F.col("groups").cast("array<string>"), ",")}
    )


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.nearest_facilities(views.anomaly_events(spark, sf_dir), views.facility_elements(spark, sf_dir))


@query("""
SELECT event_id, CAST(rank AS INTEGER) AS rank, element_id, fname AS name, type, source_category, lat, lon, distance_km, direction, tag_text AS tags FROM nearest""",
       ("nearest",))
def facility_nearest30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).withColumn("tags", context_text(F.col("tags")))


@query("""
SELECT event_id, COUNT(*)::INTEGER AS n_facilities, string_agg('- ' || fname || ': ' || REPLACE(type, '_', ' ') || ', ' || CAST(distance_km AS VARCHAR) || 'km ' || direction
  || ' [' || concat_ws(', ', 'operator="' || operator || '"', 'industrial="' || industrial || '"', 'man_made="' || man_made || '"', 'amenity="' || amenity || '"') || ']', chr(10) ORDER BY rank) AS facilities_text
FROM nearest GROUP BY event_id""", ("nearest",))
def facility_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility lists as the lines of a prompt."""
    return facilities.facility_lines(_nearest(spark, sf_dir))


@query("""
SELECT event_id, CAST(source_rank AS INTEGER) AS source_rank, fname AS source_name, source_category AS source_type,
  CASE WHEN type IN ('wastewater_plant', 'chemical_plant', 'waste_disposal') AND distance_km < 15 THEN 'high'
    WHEN distance_km < 10 THEN CASE WHEN source_category <> 'agricultural' THEN 'high' ELSE 'medium' END
    WHEN distance_km < 20 THEN 'medium' ELSE 'low' END AS likelihood,
  fname || ' is a ' || REPLACE(type, '_', ' ') || ' facility located ' || CAST(distance_km AS VARCHAR) || 'km ' || direction || ' of the anomaly, operated by ' || operator || '. '
    || CASE WHEN distance_km < 10 THEN 'Direct discharge pathway likely.' ELSE 'Potential contributor via watershed drainage.' END AS evidence,
  distance_km, lat, lon
FROM top_sources""", ("top_sources",))
def probable_sources_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.probable_sources(_nearest(spark, sf_dir))
    at = F.col("coordinates")
    return rows.withColumns({"lat": at[0], "lon": at[1]}).drop("coordinates")


@query("""
SELECT event_id, CAST(step AS INTEGER) AS source_rank, source_name, source_type, likelihood, evidence || ' Detailed facility data temporarily unavailable.' AS evidence, distance_km FROM (
  SELECT event_id, 1 AS step, 'Upstream nutrient loading' AS source_name, 'agricultural' AS source_type, 'high' AS likelihood, 'Elevated chl-a (' || printf('%.1f', chl_a_value) || ' mg/m³) consistent with agricultural nutrient runoff.' AS evidence, 15e0 AS distance_km, 'critical' AS wanted, severity FROM anomaly_events
  UNION ALL SELECT event_id, 2, 'Municipal wastewater discharge', 'municipal', 'medium', 'Proximity to populated areas suggests potential wastewater contribution.', 10e0, 'critical', severity FROM anomaly_events
  UNION ALL SELECT event_id, 1, 'Agricultural nutrient runoff', 'agricultural', 'high', 'Chl-a at ' || printf('%.1f', chl_a_value) || ' mg/m³ indicates nutrient enrichment.', 15e0, 'severe', severity FROM anomaly_events
  UNION ALL SELECT event_id, 1, 'Seasonal algal productivity', 'natural', 'high', 'Natural variation in phytoplankton productivity.', 0e0, 'moderate', severity FROM anomaly_events) s
WHERE wanted = severity AND event_id NOT IN (SELECT event_id FROM nearest)""", ("nearest",))
def fallback_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.fallback_sources(views.anomaly_events(spark, sf_dir), _nearest(spark, sf_dir))
    return rows.drop("coordinates")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.anomalies(views.detections(spark, sf_dir))


@query(f"""
SELECT event_id, UPPER(severity) AS alert_level,
  'Satellite sensors detected anomalous chlorophyll-a concentration of ' || printf('%.1f', chl_a_value) || ' mg/m³ near ' || location_name || ' on ' || strftime(date, '%Y-%m-%d') || ', '
  || CASE weather_context WHEN 'post_rainfall_runoff' THEN 'following heavy rainfall (post-rainfall runoff conditions)'
    WHEN 'wind_driven_resuspension' THEN 'during high wind conditions causing sediment resuspension' ELSE 'under calm atmospheric conditions suggesting sustained nutrient input' END
  || '. This represents a ' || printf('%.1f', chl_a_value / GREATEST(chl_a_baseline, 1e0)) || 'x deviation from the rolling baseline of ' || printf('%.1f', chl_a_baseline) || ' mg/m³ (z-score: ' || printf('%.1f', z_score) || '). '
  || CASE severity WHEN 'critical' THEN 'Immediate public health response recommended.' WHEN 'severe' THEN 'Enhanced monitoring of downstream water intakes advised.' ELSE 'Continued satellite monitoring recommended.' END AS alert_summary,
  location_name, chl_a_value > 10 AS who_threshold_exceeded, CASE WHEN chl_a_value > 20 THEN 'algal_toxins' ELSE 'nutrient_loading' END AS contaminant_type,
  'Increase sampling frequency at downstream intakes. Current chl-a of ' || printf('%.1f', chl_a_value) || ' mg/m³ ' || CASE WHEN chl_a_value > 10 THEN 'exceeds' ELSE 'approaches' END || ' WHO bloom indicator threshold of 10 µg/L.' AS recommended_monitoring,
  'Anomaly detected near ' || location_name || ' via Sentinel-3 OLCI. Real-time satellite monitoring enables early detection of harmful algal blooms before they impact drinking water supplies.' AS historical_context
FROM (SELECT *, {label()} AS location_name FROM anomalies) a""", ("anomalies",))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_summary(_flagged(spark, sf_dir))


def _actions_sql() -> str:
    place, amount = label(), "printf('%.0f', chl_a_value)"
    steps = [
        ("critical", 0, "immediate", f"'Issue public health advisory for communities near ' || {place}", "Local health department"),
        ("critical", 1, "immediate", f"'Deploy rapid toxin testing at chl-a ' || {amount} || ' mg/m³'", "Water utility operators"),
        ("critical", 2, "within_24h", "'Coordinate with upstream agencies to identify point sources'", "Environmental protection agency"),
        ("critical", 3, "within_week", "'Publish community water quality bulletin with satellite evidence'", "Public communications office"),
        ("severe", 0, "immediate", f"'Increase water intake sampling frequency near ' || {place} || ' (chl-a at ' || {amount} || ' mg/m³)'", "Water utility operators"),
        ("severe", 1, "within_24h", "'Deploy additional monitoring at anomaly location'", "Environmental monitoring agency"),
        ("severe", 2, "within_week", "'Review upstream discharge permits for recent violations'", "Environmental protection agency"),
        ("moderate", 0, "within_24h", f"'Flag ' || {place} || ' for enhanced monitoring on next satellite pass'", "Remote sensing team"),
        ("moderate", 1, "within_week", "'Cross-reference with weather forecast to assess escalation risk'", "Environmental monitoring agency"),
    ]
    return " UNION ALL ".join(
        f"SELECT event_id, CAST({step} AS INTEGER) AS step, '{priority}' AS priority, {action} AS action, '{party}' AS responsible_party FROM anomalies WHERE severity = '{severity}'"
        for severity, step, priority, action, party in steps
    )


@query(_actions_sql(), ("anomalies",))
def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_actions(_flagged(spark, sf_dir))


@query()
def report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested reports of all events, as JSON text."""
    events = views.anomaly_events(spark, sf_dir)
    reports = report.community_reports(events, _nearest(spark, sf_dir))
    fields = [f.name for f in schemas.COMMUNITY_REPORT]
    return reports.select("event_id", "report_key", F.to_json(F.struct(*fields)).alias("report"))


@query()
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.anomaly_events(spark, sf_dir)
    return report.render_text(report.community_reports(events, _nearest(spark, sf_dir)), events)


@query("""
SELECT s.event_id, CAST(s.source_rank AS INTEGER) AS source_rank, s.source_name, CASE WHEN (s.km IS NULL OR s.km = 0) AND m.event_id IS NOT NULL THEN m.distance_km ELSE s.km END AS distance_km, m.lat, m.lon
FROM (SELECT event_id, source_rank, CASE source_rank % 4 WHEN 0 THEN UPPER(fname) WHEN 1 THEN 'The ' || fname || ' site' WHEN 2 THEN SUBSTRING(fname, 2, 4) ELSE 'zzz' END AS source_name,
  CASE source_rank % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 99e-1 END AS km FROM top_sources) s
LEFT JOIN (
  SELECT * FROM (
    SELECT p.event_id, p.source_rank, f.distance_km, f.lat, f.lon,
      ROW_NUMBER() OVER (PARTITION BY p.event_id, p.source_rank ORDER BY CASE WHEN f.lname = p.sname THEN 0 ELSE 1 END, f.first_rank) AS rn
    FROM (SELECT event_id, source_rank, LOWER(CASE source_rank % 4 WHEN 0 THEN UPPER(fname) WHEN 1 THEN 'The ' || fname || ' site' WHEN 2 THEN SUBSTRING(fname, 2, 4) ELSE 'zzz' END) AS sname FROM top_sources) p
    JOIN (SELECT * FROM (SELECT *, LOWER(fname) AS lname, MIN(rank) OVER (PARTITION BY event_id, LOWER(fname)) AS first_rank,
        ROW_NUMBER() OVER (PARTITION BY event_id, LOWER(fname) ORDER BY rank DESC) AS from_last FROM nearest) l WHERE from_last = 1) f
      ON f.event_id = p.event_id AND (contains(p.sname, f.lname) OR contains(f.lname, p.sname))) q
  WHERE rn = 1) m ON m.event_id = s.event_id AND m.source_rank = s.source_rank""", ("top_sources",))
def source_coord_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as a model may name them, matched back to the mapped facilities."""
    nearest = stage(_nearest(spark, sf_dir), "facilities")
    place, name = F.col("source_rank"), F.col("source_name")
    told = report.probable_sources(nearest).select(
        "event_id",
        "source_rank",
        F.when(place % 4 == 0, F.upper(name)).when(place % 4 == 1, F.concat(F.lit("The "), name, F.lit(" site")))
        .when(place % 4 == 2, F.substring(name, 2, 4)).otherwise("zzz").alias("source_name"),
        F.when(place % 3 == 0, 0e0).when(place % 3 == 1, 99e-1).alias("distance_km"),
        F.lit(None).cast("array<double>").alias("coordinates"),
    )
    rows = report.match_source_coordinates(told, nearest)
    at = F.col("coordinates")
    return rows.withColumns({"lat": at[0], "lon": at[1]}).drop("coordinates")


_SEARCHES = """
SELECT c_custkey AS search_id, CASE c_custkey % 7
  WHEN 0 THEN printf('%.2f', a) || ', ' || printf('%.2f', b) WHEN 1 THEN printf('%.2f', ABS(a)) || '°N ' || printf('%.2f', ABS(b)) || '°W'
  WHEN 2 THEN ' ' || printf('%.1f', b - 90) || ',' || printf('%.1f', a) WHEN 3 THEN c_name WHEN 4 THEN printf('%.2f', a) || ', ' || printf('%.2f', b) || ', 3'
  WHEN 5 THEN c_custkey || ' ' || c_custkey ELSE '-' || c_custkey % 90 || '.' || '   ' || c_custkey % 180 || 's' END AS query
FROM (SELECT *, (c_custkey % 161) / 1e0 - 80 AS a, (c_custkey % 181) / 1e0 - 90 AS b FROM customer) c"""


@query(rf"""
SELECT search_id, query, CASE WHEN ABS(x) <= 90 AND ABS(y) <= 180 THEN x WHEN ABS(y) <= 90 AND ABS(x) <= 180 THEN y END AS lat,
  CASE WHEN ABS(x) <= 90 AND ABS(y) <= 180 THEN y WHEN ABS(y) <= 90 AND ABS(x) <= 180 THEN x END AS lon
FROM (SELECT *, TRY_CAST(regexp_extract(cleaned, '^(-?\d+\.?\d*)[,\s]+(-?\d+\.?\d*)$', 1) AS DOUBLE) AS x, TRY_CAST(regexp_extract(cleaned, '^(-?\d+\.?\d*)[,\s]+(-?\d+\.?\d*)$', 2) AS DOUBLE) AS y
  FROM (SELECT *, regexp_replace(TRIM(query), '[°NSEWnsew]', '', 'g') AS cleaned FROM ({_SEARCHES}) s) c) p""")
def coord_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates typed into the search box in several styles, and names that are none."""
    key = F.col("c_custkey")
    a, b = (key % 161) / 1e0 - 80, (key % 181) / 1e0 - 90
    style, number = key % 7, key.cast("string")
    typed = (
        F.when(style == 0, F.concat(text.fixed(a, 2), F.lit(", "), text.fixed(b, 2)))
        .when(style == 1, F.concat(text.fixed(F.abs(a), 2), F.lit("°N "), text.fixed(F.abs(b), 2), F.lit("°W")))
        .when(style == 2, F.concat(F.lit(" "), text.fixed(b - 90, 1), F.lit(","), text.fixed(a, 1)))
        .when(style == 3, F.col("c_name"))
        .when(style == 4, F.concat(text.fixed(a, 2), F.lit(", "), text.fixed(b, 2), F.lit(", 3")))
        .when(style == 5, F.concat(number, F.lit(" "), number))
        .otherwise(F.concat(F.lit("-"), (key % 90).cast("string"), F.lit(".   "), (key % 180).cast("string"), F.lit("s")))
    )
    rows = views.table(spark, sf_dir, "customer").select(key.alias("search_id"), typed.alias("query"))
    return rows.withColumn("at", text.parse_coordinates(F.col("query"))).select("search_id", "query", "at.lat", "at.lon")


_WATER = "|".join(text.WATER_WORDS)


@query(f"""
SELECT result_id, CASE WHEN instr(place, ',') = 0 THEN place ELSE TRIM(SUBSTRING(place, 1, instr(place, ',') - 1)) END AS title,
  CASE WHEN instr(place, ',') = 0 THEN '' ELSE TRIM(SUBSTRING(place, instr(place, ',') + 1)) END AS context, regexp_matches(LOWER(place), '{_WATER}') AS is_water
FROM (SELECT p_partkey AS result_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', ' || p_brand WHEN 2 THEN p_name || ' Lake , ' || p_type || ', ' || p_brand ELSE 'Great ' || p_name || ' RIVER,' || p_type END AS place FROM part) p""")
def water_name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results split into title and context, water bodies first."""
    key, name, kind, brand = (F.col(f"p_{c}") for c in ("partkey", "name", "type", "brand"))
    place = (
        F.when(key % 4 == 0, name)
        .when(key % 4 == 1, F.concat_ws(", ", name, brand))
        .when(key % 4 == 2, F.concat(name, F.lit(" Lake , "), kind, F.lit(", "), brand))
        .otherwise(F.concat(F.lit("Great "), name, F.lit(" RIVER,"), kind))
    )
    results = views.table(spark, sf_dir, "part").select(key.alias("result_id"), place.alias("place"))
    where = F.col("place")
    return results.select(
        "result_id", text.place_title(where).alias("title"), text.place_context(where).alias("context"),
        text.is_water_name(where).alias("is_water"),
    ).orderBy(F.desc("is_water"), "result_id")


@query(f"""
SELECT s_suppkey AS place_id, COALESCE(NULLIF(array_to_string(parts[1:3], ', '), ''), {label()}) AS place FROM (
  SELECT *, list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'Lake ' || n_name END, CASE WHEN s_suppkey % 5 = 0 THEN 'City ' || s_suppkey % 7 END,
    CASE WHEN s_suppkey % 11 <> 0 THEN r_name END, CASE WHEN s_suppkey % 11 <> 0 THEN n_name END], lambda x: x IS NOT NULL) AS parts,
    s_suppkey % 20 - 1e1 AS lat, 1e1 - s_suppkey % 20 AS lon
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) p""")
def place_name_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place names from reverse-geocoding JSON; the county repeats the name of the water body."""
    key = F.col("s_suppkey")
    tables = {name: views.table(spark, sf_dir, name) for name in ("supplier", "nation", "region")}
    rows = (
        tables["supplier"]
        .join(tables["nation"], F.col("n_nationkey") == F.col("s_nationkey"))
        .join(tables["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    )
    name = F.when(key % 2 == 0, F.concat(F.lit("Lake "), "n_name")).otherwise("")
    known = key % 11 != 0
    answer = F.to_json(F.struct(
        name.alias("name"),
        F.struct(
            F.when(key % 5 == 0, F.concat(F.lit("City "), (key % 7).cast("string"))).alias("city"),
            name.alias("county"),
            F.when(known, F.col("r_name")).alias("state"),
            F.when(known, F.col("n_name")).alias("country"),
        ).alias("address"),
    ))
    fallback = geo.location_label(key % 20 - 1e1, 1e1 - key % 20)
    parsed = rows.withColumn("answer", F.from_json(answer, schemas.PLACE))
    return parsed.select(key.alias("place_id"), text.compose_place_name(F.col("answer"), fallback).alias("place"))


_MODEL_OUTPUT = """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Here is the report: ' || body || ' I hope it helps.' WHEN 2 THEN text ELSE body END AS raw
FROM (SELECT *, CAST(to_json(struct_pack(alert_level := UPPER(role), alert_summary := text, historical_context := role)) AS VARCHAR) AS body FROM conversations) c"""


@query(f"""
SELECT conv_id, turn, body IS NOT NULL AS parsed,
  CASE WHEN body IS NULL THEN 'MODERATE' ELSE json_extract_string(body, '$.alert_level') END AS alert_level,
  CASE WHEN body IS NULL THEN 'Report generation encountered an error. Manual review required.' ELSE json_extract_string(body, '$.alert_summary') END AS alert_summary,
  CASE WHEN body IS NULL THEN 'No historical context available.' ELSE json_extract_string(body, '$.historical_context') END AS historical_context
FROM (SELECT *, CASE WHEN json_valid(cleaned) THEN cleaned WHEN json_valid(braces) THEN braces END AS body
  FROM (SELECT *, regexp_extract(cleaned, '(?s)\\{{.*\\}}') AS braces
    FROM (SELECT *, regexp_replace(regexp_replace(raw, '```(?:json)?\\s*', '', 'g'), '^\\s+|[\\s`]+$', '', 'g') AS cleaned FROM ({_MODEL_OUTPUT}) m) c) b) j""")
def model_output_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports read back from fenced, embedded, plain and unreadable model output."""
    body = F.to_json(F.struct(
        F.upper("role").alias("alert_level"), F.col("text").alias("alert_summary"), F.col("role").alias("historical_context")
    ))
    style = F.col("turn") % 4
    raw = (
        F.when(style == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(style == 1, F.concat(F.lit("Here is the report: "), body, F.lit(" I hope it helps.")))
        .when(style == 2, F.col("text"))
        .otherwise(body)
    )
    outputs = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return modeloutput.parse_reports(outputs).select(
        "conv_id", "turn", "parsed", "report.alert_level", "report.alert_summary", "report.historical_context"
    )
