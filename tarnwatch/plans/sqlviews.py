"""SQL text of the logical inputs, for the oracle.

Amounts are summed in whole cents and ``chl_a`` is a multiple of 1/1024, so sums are exact and do
not depend on their order. Decimals carry an exponent, which makes them doubles.
"""

from __future__ import annotations

HAVERSINE = (
    "12742e0 * ASIN(SQRT(LEAST(1e0, POWER(SIN(RADIANS({lat2} - {lat1}) / 2), 2) "
    "+ COS(RADIANS({lat1})) * COS(RADIANS({lat2})) * POWER(SIN(RADIANS({lon2} - {lon1}) / 2), 2))))"
)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def label(lat: str = "lat", lon: str = "lon") -> str:
    return (
        f"printf('%.2f', ABS({lat})) || CASE WHEN {lat} >= 0 THEN 'N' ELSE 'S' END || ', ' || "
        f"printf('%.2f', ABS({lon})) || CASE WHEN {lon} >= 0 THEN 'E' ELSE 'W' END"
    )


def rolling(source: str, keys: str) -> str:
    along = f"PARTITION BY {keys} ORDER BY date"
    trailing = f"{along} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING"
    return f"""
SELECT *, (chl_a - chl_a_rolling_mean) / CASE WHEN chl_a_rolling_std IS NOT NULL THEN GREATEST(chl_a_rolling_std, 1e0) END AS chl_a_zscore
FROM (
  SELECT *,
    SUM(chl_a) OVER ({trailing}) / NULLIF(COUNT(chl_a) OVER ({trailing}), 0) AS chl_a_rolling_mean,
    STDDEV_SAMP(chl_a) OVER ({trailing}) AS chl_a_rolling_std,
    chl_a - LAG(chl_a, 1) OVER ({along}) AS chl_a_delta_1w,
    chl_a - LAG(chl_a, 2) OVER ({along}) AS chl_a_delta_2w,
    chl_a - SUM(chl_a) OVER (PARTITION BY {keys}, EXTRACT(WEEK FROM date)) / COUNT(chl_a) OVER (PARTITION BY {keys}, EXTRACT(WEEK FROM date)) AS chl_a_seasonal_residual,
    CASE WHEN precipitation_7d > 50 THEN 1 ELSE 0 END AS recent_heavy_rain,
    CASE WHEN wind_speed > 8 THEN 1 ELSE 0 END AS high_wind
  FROM {source}) t"""


def ensemble(source: str, threshold: str) -> str:
    return f"""
SELECT region_id, cell_id, date, lat, lon,
  CASE WHEN NOT ({threshold}) THEN 'none' WHEN ABS(z) > 4 THEN 'critical' WHEN ABS(z) > 3 THEN 'severe' ELSE 'moderate' END AS severity,
  LEAST(35e-2 * z_flag + 35e-2 * iso_flag + 3e-1 * spatial_flag, 1e0) AS confidence,
  chl_a AS chl_a_value, chl_a_rolling_mean AS chl_a_baseline, z AS z_score,
  CASE WHEN recent_heavy_rain <> 0 THEN 'post_rainfall_runoff' WHEN high_wind <> 0 THEN 'wind_driven_resuspension' ELSE 'calm_conditions' END AS weather_context,
  region_id || '_' || strftime(date, '%Y-%m-%d') || '_' || CAST(ROUND(lat, 4) AS VARCHAR) || '_' || CAST(ROUND(lon, 4) AS VARCHAR) AS event_id
FROM (SELECT *, COALESCE(chl_a_zscore, 0e0) AS z, CASE WHEN ABS(COALESCE(chl_a_zscore, 0e0)) > 2 THEN 1e0 ELSE 0e0 END AS z_flag FROM {source}) v"""


IN_DOUBLES = "35e-2 * z_flag + 35e-2 * iso_flag + 3e-1 * spatial_flag >= 65e-2"
IN_PERCENT = "35 * z_flag + 35 * iso_flag + 30 * spatial_flag >= 65"
STAND_IN = "CASE WHEN ABS(chl_a_seasonal_residual) > 35 OR ABS(chl_a_delta_1w) > 60 THEN 1e0 ELSE 0e0 END AS iso_flag"


def spatial(source: str, same_date: bool = False) -> str:
    """Rows with their spatial flag, counted by comparing all sites of a region."""
    date = ", date" if same_date else ""
    match = "AND h.date = p.date" if same_date else ""
    again = "AND n.date = f.date" if same_date else ""
    return f"""
SELECT f.*, CASE WHEN ABS(f.chl_a_zscore) > 2 AND n.hot - 1 >= 2 THEN 1e0 ELSE 0e0 END AS spatial_flag
FROM {source} f LEFT JOIN (
  SELECT p.region_id, p.cell_id{', p.date' if same_date else ''}, SUM(h.hot) AS hot
  FROM (SELECT region_id, cell_id, lat, lon{date}, COUNT(*) AS hot FROM {source} WHERE ABS(chl_a_zscore) > 15e-1 GROUP BY ALL) p
  JOIN (SELECT region_id, cell_id, lat, lon{date}, COUNT(*) AS hot FROM {source} WHERE ABS(chl_a_zscore) > 15e-1 GROUP BY ALL) h
    ON h.region_id = p.region_id {match} AND {haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')} <= 10
  GROUP BY ALL) n ON n.region_id = f.region_id AND n.cell_id = f.cell_id {again}"""


def tile_place(key: str) -> tuple[str, str]:
    return f"{key} % 160 - 8e1 + ({key} % 7) / 8e0", f"({key} * 37) % 360 - 18e1 + ({key} % 5) / 8e0"


def _edge_list(points: list[tuple[str, str]]) -> str:
    """A list of edges along the points, back to the first."""
    pairs = zip(points, points[1:] + points[:1])
    return "[" + ", ".join(f"{{'x1': {a}, 'y1': {b}, 'x2': {c}, 'y2': {d}}}" for (a, b), (c, d) in pairs) + "]"


_OUTER = _edge_list([("x", "y"), ("x + w", "y + 1"), ("x + w + s", "y + h + 1"), ("x + s", "y + h")])
_HOLE = _edge_list([("cx - 1", "cy"), ("cx", "cy + 1"), ("cx + 1", "cy"), ("cx", "cy - 1")])
_SECOND = _edge_list([("x + 30", "y"), ("x + 32", "y"), ("x + 32", "y + 2"), ("x + 30", "y + 2")])
_SIDES = ", ".join(f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in ("bw", "be") for y in ("bs", "bn"))


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "box_regions": ((), """
SELECT CAST(s_suppkey AS BIGINT) AS region_id, (s_suppkey * 37) % 140 - 7e1 + (s_suppkey % 8) / 8e0 AS lat,
  CASE WHEN s_suppkey % 10 = 0 THEN 17975e-2 WHEN s_suppkey % 10 = 5 THEN -179875e-3 ELSE (s_suppkey * 53) % 360 - 18e1 + (s_suppkey % 4) / 4e0 END AS lon
FROM supplier"""),
    "footprint_edges": (("shapes",), f"""
SELECT product_id, product_time, part, UNNEST(edges, recursive := true) FROM (
  SELECT product_id, product_time, 0 AS part, CASE WHEN product_id % 11 = 0 THEN list_concat({_OUTER}, {_HOLE}) ELSE {_OUTER} END AS edges FROM shapes
  UNION ALL SELECT product_id, product_time, 1, {_SECOND} FROM shapes WHERE product_id % 7 = 0) e"""),
    "shapes": ((), """
SELECT *, x + w / 2 + s / 2 AS cx, y + (h + 1) / 2 AS cy FROM (
  SELECT CAST(o_orderkey AS BIGINT) AS product_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS product_time,
    (o_orderkey * 7919 % 23040) / 64e0 - 18e1 AS x, (o_orderkey * 104729 % 9600) / 64e0 - 75e0 AS y,
    CAST(o_orderkey % 9 + 4 AS DOUBLE) AS w, CAST(o_orderkey % 7 + 3 AS DOUBLE) AS h, CAST(o_orderkey % 5 - 2 AS DOUBLE) AS s
  FROM orders WHERE NOT (o_orderkey % 2 = 1 AND o_orderkey % 10 = 1)) o"""),
    "box_hits": (("box_regions", "shapes", "footprint_edges"), f"""
SELECT DISTINCT region_id, product_id, product_time FROM (
  SELECT region_id, product_id, product_time, part, turn,
    bool_or(LEAST(x1, x2) <= be AND GREATEST(x1, x2) >= bw AND LEAST(y1, y2) <= bn AND GREATEST(y1, y2) >= bs
      AND LEAST({_SIDES}) <= 0 AND GREATEST({_SIDES}) >= 0) AS touched,
    COUNT(*) FILTER (WHERE (y1 > bs) <> (y2 > bs) AND bw < (x2 - x1) * (bs - y1) / NULLIF(y2 - y1, 0) + x1) AS passed
  FROM (SELECT region_id, turn, lat - 5e-1 AS bs, lat + 5e-1 AS bn, lon - 5e-1 + turn AS bw, lon + 5e-1 + turn AS be FROM box_regions, (SELECT UNNEST([-36e1, 0e0, 36e1]) AS turn) t) b
  JOIN (SELECT * FROM footprint_edges JOIN (SELECT product_id AS p, part AS q, MIN(x1) AS fw, MAX(x1) AS fe, MIN(y1) AS fs, MAX(y1) AS fn FROM footprint_edges GROUP BY ALL) x ON p = product_id AND q = part) e
    ON fw <= be AND fe >= bw AND fs <= bn AND fn >= bs
  GROUP BY ALL) h
WHERE touched OR passed % 2 = 1"""),
    "tile_rows": ((), f"""
SELECT 'p' || CAST(FLOOR(l_partkey / 25e0) AS BIGINT) AS region_id, CAST(l_shipdate AS DATE) AS date, {tile_place("l_partkey")[0]} AS lat, {tile_place("l_partkey")[1]} AS lon,
  FLOOR(l_extendedprice) / 1024e0 AS chl_a, CAST(l_quantity AS DOUBLE) AS turbidity, l_returnflag AS source
FROM lineitem"""),
    "tile_events": ((), f"""
SELECT 'e' || s_suppkey AS name, {tile_place("(s_suppkey * 13)")[0]} + (s_suppkey % 5 - 2) / 4e0 AS lat, {tile_place("(s_suppkey * 13)")[1]} + (s_suppkey % 3 - 1) / 2e0 AS lon,
  CAST(DATE '1992-03-01' + CAST((s_suppkey * 23) % 2400 AS INTEGER) AS DATE) AS date
FROM supplier"""),
    "tile_revised": (("tile_rows",), """
SELECT * REPLACE (chl_a + 1 AS chl_a) FROM tile_rows WHERE turbidity > 10 AND CAST(SUBSTRING(region_id, 2) AS BIGINT) % 4 = 0 AND EXTRACT(YEAR FROM date) >= 1995"""),
    "tile_store": (("tile_rows", "tile_revised"), """
SELECT * FROM tile_rows WHERE (region_id, EXTRACT(YEAR FROM date)) NOT IN (SELECT (region_id, EXTRACT(YEAR FROM date)) FROM tile_revised)
UNION ALL SELECT * FROM tile_revised"""),
    "observations": ((), """
SELECT CAST(FLOOR(l_suppkey / 1e2) AS BIGINT) AS region_id,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  ROUND(3e1 + (l_suppkey % 10) * 5e-2 + (CAST(FLOOR(l_suppkey / 1e2) AS BIGINT) % 12) * 5e0, 4) AS lat,
  ROUND(-8e1 + (CAST(FLOOR(l_suppkey / 1e1) AS BIGINT) % 10) * 5e-2 + (CAST(FLOOR(l_suppkey / 12e2) AS BIGINT) % 50) * 5e0, 4) AS lon,
  l_suppkey AS cell_id,
  FLOOR(CAST(SUM(CAST(ROUND(l_extendedprice * 1e2) AS BIGINT)) AS DOUBLE) / COUNT(*) / 1e5 * 1024e0) / 1024e0 AS chl_a,
  SUM(l_quantity) / COUNT(*) * 15e-2 AS turbidity,
  CAST(SUM(CAST(ROUND(l_tax * 1e2) AS BIGINT)) AS DOUBLE) / COUNT(*) - 4e0 AS sst_delta,
  SUM(l_quantity) AS precipitation_7d,
  CAST(SUM(CAST(ROUND(l_discount * 1e2) AS BIGINT)) AS DOUBLE) / COUNT(*) AS wind_speed
FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE)"""),
    "arrivals": (("observations",), """
SELECT *, cell_id * 100000 + date_diff('day', DATE '1990-01-01', date) AS ordinal FROM observations"""),
    "raw_observations": (("arrivals",), """
SELECT region_id, cell_id, ordinal,
  CASE WHEN k % 50 = 7 THEN 'bad-date' ELSE strftime(date, '%Y-%m-%d') || 'T00:00:00Z' END AS time,
  CAST(lat + 3e-5 AS VARCHAR) AS latitude, CAST(lon + 3e-5 AS VARCHAR) AS longitude,
  CASE WHEN k % 20 = 3 THEN 'NaN' WHEN k % 20 = 4 THEN '-1.0' WHEN k % 20 = 5 THEN '412.0' WHEN k % 20 = 6 THEN 'n/a' ELSE CAST(chl_a AS VARCHAR) END AS chlorophyll,
  CASE WHEN k % 7 <> 0 THEN turbidity END AS turbidity
FROM (SELECT *, CAST(FLOOR(chl_a * 1024e0) AS BIGINT) AS k FROM arrivals) a"""),
    "cleaned": (("raw_observations",), """
SELECT * FROM (
  SELECT region_id, cell_id, ordinal, TRY_CAST(SUBSTRING(time, 1, 10) AS DATE) AS date,
    ROUND(TRY_CAST(latitude AS DOUBLE), 4) AS lat, ROUND(TRY_CAST(longitude AS DOUBLE), 4) AS lon,
    TRY_CAST(chlorophyll AS DOUBLE) AS chl_a, turbidity
  FROM raw_observations) r
WHERE date IS NOT NULL AND NOT isnan(chl_a) AND chl_a > 0 AND chl_a < 300"""),
    "rolled": (("arrivals",), rolling("arrivals", "region_id, cell_id")),
    "features": (("rolled",), "SELECT * FROM rolled WHERE chl_a_rolling_std IS NOT NULL AND chl_a_delta_2w IS NOT NULL"),
    "features_iso": (("features",), f"SELECT *, {STAND_IN} FROM features"),
    "voted": (("features_iso",), spatial("features_iso")),
    "detections": (("voted",), ensemble("voted", IN_DOUBLES)),
    "detections_exact": (("voted",), ensemble("voted", IN_PERCENT)),
    "anomalies": (("detections",), "SELECT * FROM detections WHERE severity <> 'none'"),
    "timeline_points": (("detections",), """
SELECT region_id, date, AVG(chl_a_value) AS chl_a_value, AVG(chl_a_baseline) AS chl_a_baseline, AVG(z_score) AS z_score, AVG(confidence) AS confidence,
  CASE MAX(CASE severity WHEN 'none' THEN 0 WHEN 'moderate' THEN 1 WHEN 'severe' THEN 2 ELSE 3 END) WHEN 0 THEN 'none' WHEN 1 THEN 'moderate' WHEN 2 THEN 'severe' ELSE 'critical' END AS severity
FROM detections GROUP BY region_id, date"""),
    "elements": ((), """
SELECT p_partkey AS element_id, CASE WHEN p_partkey % 3 <> 0 THEN 'node' ELSE 'way' END AS element_type,
  ROUND(-58e0 + (cluster % 58) * 2e0 + (p_partkey % 50) * 4e-3, 4) AS lat,
  ROUND(-17e1 + (CAST(FLOOR(cluster / 58e0) AS BIGINT) % 85) * 4e0 + (p_partkey % 40) * 6e-3, 4) AS lon,
  CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name,
  CASE p_size % 8 WHEN 0 THEN 'wastewater_plant' WHEN 4 THEN 'works' END AS man_made,
  CASE p_size % 8 WHEN 1 THEN 'chemical' WHEN 2 THEN 'slaughterhouse' END AS industrial,
  CASE p_size % 8 WHEN 3 THEN 'waste_disposal' END AS amenity,
  CASE p_size % 8 WHEN 5 THEN 'industrial' WHEN 6 THEN 'farmland' END AS landuse,
  CASE p_size % 8 WHEN 7 THEN LOWER(p_type) END AS craft,
  p_brand AS operator
FROM (SELECT *, CAST(FLOOR(p_partkey / 1e3) AS BIGINT) AS cluster FROM part) p"""),
    "facilities": (("elements",), """
SELECT *, COALESCE(name, operator) AS fname,
  CASE type WHEN 'wastewater_plant' THEN 'municipal' WHEN 'waste_disposal' THEN 'municipal' WHEN 'farmland' THEN 'agricultural' ELSE 'industrial' END AS source_category,
  concat_ws(';', 'amenity=' || amenity, 'industrial=' || industrial, 'landuse=' || landuse, 'man_made=' || man_made, 'operator=' || operator) AS tag_text,
  list_filter([CASE WHEN man_made IS NOT NULL OR industrial IS NOT NULL OR amenity IS NOT NULL THEN 1 END,
    CASE WHEN (name IS NOT NULL AND (industrial IS NOT NULL OR (element_type = 'way' AND landuse = 'industrial'))) OR craft IS NOT NULL THEN 2 END,
    CASE WHEN element_type = 'way' AND landuse = 'industrial' THEN 3 END,
    CASE WHEN element_type = 'way' AND landuse = 'farmland' THEN 4 END], lambda g: g IS NOT NULL) AS groups
FROM (SELECT *, CASE WHEN man_made = 'wastewater_plant' THEN 'wastewater_plant' WHEN amenity = 'waste_disposal' THEN 'waste_disposal'
    WHEN industrial = 'chemical' THEN 'chemical_plant' WHEN industrial = 'slaughterhouse' THEN 'slaughterhouse' WHEN man_made = 'works' THEN 'industrial_works'
    WHEN landuse = 'farmland' THEN 'farmland' WHEN landuse = 'industrial' THEN 'industrial_zone' WHEN craft IS NOT NULL THEN 'craft_' || craft ELSE 'industrial' END AS type
  FROM elements) e"""),
    "anomaly_events": ((), """
SELECT s_suppkey AS event_id, 'r' || cluster AS region_id, CAST(DATE '1995-01-01' + CAST(s_suppkey % 2000 AS INTEGER) AS DATE) AS date,
  ROUND(-58e0 + (cluster % 58) * 2e0 + (s_suppkey % 10) * 5e-2 + CASE WHEN s_suppkey % 10 >= 7 THEN 2e-1 ELSE 0e0 END, 4) AS lat,
  ROUND(-17e1 + (CAST(FLOOR(cluster / 58e0) AS BIGINT) % 85) * 4e0 + (CAST(FLOOR(s_suppkey / 1e1) AS BIGINT) % 5) * 5e-2 + CASE WHEN s_suppkey % 25 = 0 THEN 2e0 ELSE 0e0 END, 4) AS lon,
  CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'severe' ELSE 'moderate' END AS severity,
  7e-1 AS confidence, chl AS chl_a_value, chl / 4e0 AS chl_a_baseline, (s_suppkey % 40) / 8e0 AS z_score,
  CASE s_suppkey % 4 WHEN 0 THEN 'post_rainfall_runoff' WHEN 1 THEN 'wind_driven_resuspension' ELSE 'calm_conditions' END AS weather_context
FROM (SELECT *, CAST(FLOOR(s_suppkey / 5e1) AS BIGINT) AS cluster, FLOOR(ABS(s_acctbal)) / 128e0 AS chl FROM supplier) s"""),
    "nearest": (("facilities", "anomaly_events"), f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY distance_km, grp, element_id) AS rank FROM (
  SELECT *, ROUND_EVEN(d, 1) AS distance_km,
    list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(ROUND_EVEN(((DEGREES(ATAN2(
      SIN(RADIANS(lon - elon)) * COS(RADIANS(lat)),
      COS(RADIANS(elat)) * SIN(RADIANS(lat)) - SIN(RADIANS(elat)) * COS(RADIANS(lat)) * COS(RADIANS(lon - elon)))) + 36e1) % 36e1) / 45e0, 0) AS INTEGER) % 8 + 1) AS direction
  FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, fname, type, CAST(ROUND(lat * 1000) AS BIGINT), CAST(ROUND(lon * 1000) AS BIGINT) ORDER BY grp, element_id) AS copy FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, grp ORDER BY d, element_id) AS in_group FROM (
        SELECT *, MIN(d) OVER (PARTITION BY event_id) AS nearest_d FROM (
          SELECT a.event_id, a.lat AS elat, a.lon AS elon, f.*, {haversine('a.lat', 'a.lon', 'f.lat', 'f.lon')} AS d
          FROM anomaly_events a JOIN (SELECT *, UNNEST(groups) AS grp FROM facilities) f ON ABS(f.lat - a.lat) < 1) x
        WHERE d <= 50) y
      WHERE d <= 25 OR nearest_d > 25) z
    WHERE in_group <= CASE grp WHEN 3 THEN 20 WHEN 4 THEN 10 ELSE 1000000000 END) u
  WHERE copy = 1) v
QUALIFY rank <= 30"""),
    "top_sources": (("nearest",), """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY CASE type WHEN 'wastewater_plant' THEN 0 WHEN 'chemical_plant' THEN 1 WHEN 'waste_disposal' THEN 2 WHEN 'slaughterhouse' THEN 3 WHEN 'industrial_works' THEN 4 WHEN 'industrial_zone' THEN 5 ELSE 10 END, distance_km, rank) AS source_rank FROM nearest) n
WHERE source_rank <= 5"""),
    "catalog_a": ((), "SELECT o_custkey AS region_id, o_orderkey AS product_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS product_time FROM orders WHERE o_orderstatus = 'O'"),
    "catalog_b": ((), "SELECT o_custkey AS region_id, o_orderkey AS product_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS product_time FROM orders WHERE o_orderstatus = 'F'"),
    "routed": ((), """
SELECT doc_id, source, text, CASE WHEN n < 6 THEN 'permits' WHEN n < 12 THEN 'agriculture' ELSE 'watershed' END AS collection
FROM (SELECT *, CAST(SUBSTRING(source, 4) AS INTEGER) AS n FROM documents) d WHERE n < 18"""),
    "chunks": ((), """
SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_index, SUBSTRING(text, CAST(i AS BIGINT) * 450 + 1, 500) AS chunk
FROM (SELECT *, UNNEST(range(0, CAST(FLOOR((LENGTH(text) - 1) / 450e0) AS BIGINT) + 1)) AS i FROM documents WHERE LENGTH(text) > 0) d"""),
    "vectors": ((), "SELECT vec_id AS doc_id, vec_id % 3 AS collection, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"),
    "labelled_events": ((), """
SELECT n_name AS name, ROUND(3e1 + (n_nationkey % 10) * 5e-2 + CASE WHEN n_nationkey % 5 = 4 THEN 3e0 ELSE 0e0 END, 4) AS lat,
  ROUND(-8e1 + (n_nationkey % 10) * 5e-2, 4) AS lon,
  CAST(DATE '1995-03-01' + CAST(n_nationkey * 90 + CASE WHEN n_nationkey % 7 = 6 THEN 4000 ELSE 0 END AS INTEGER) AS DATE) AS date,
  n_nationkey % 3 <> 0 AS bloom_confirmed
FROM nation"""),
    "event_rows": (("observations", "labelled_events"), """
SELECT o.* EXCLUDE (region_id), e.name AS region_id FROM observations o JOIN labelled_events e
  ON o.lat BETWEEN e.lat - 5e-1 AND e.lat + 5e-1 AND o.lon BETWEEN e.lon - 5e-1 AND e.lon + 5e-1 AND o.date BETWEEN e.date - 60 AND e.date + 60"""),
    "event_enough": (("event_rows",), "SELECT * FROM event_rows WHERE region_id IN (SELECT region_id FROM event_rows GROUP BY region_id HAVING COUNT(*) >= 5)"),
    "event_rolled": (("event_enough",), rolling("event_enough", "region_id, cell_id")),
    "event_features": (("event_rolled",), f"SELECT *, {STAND_IN} FROM event_rolled WHERE chl_a_rolling_std IS NOT NULL AND chl_a_delta_2w IS NOT NULL"),
    "event_voted": (("event_features",), spatial("event_features")),
    "event_detections": (("event_voted",), ensemble("event_voted", IN_DOUBLES)),
    "event_details": (("event_rows", "event_detections", "labelled_events"), f"""
SELECT e.name, e.date, e.lat, e.lon, CASE WHEN e.bloom_confirmed THEN 'bloom' ELSE 'clean' END AS expected,
  m.worst IS NOT NULL AS detected, CASE m.worst WHEN 3 THEN 'critical' WHEN 2 THEN 'severe' WHEN 1 THEN 'moderate' ELSE 'none' END AS severity,
  COALESCE(x.max_z_score, 0e0) AS max_z_score, COALESCE(x.max_chl_a, 0e0) AS max_chl_a, COALESCE(p.n, 0) AS data_points,
  e.bloom_confirmed = (m.worst IS NOT NULL) AS passed,
  CASE WHEN COALESCE(p.n, 0) = 0 THEN 'No satellite data available for this location/date' WHEN p.n < 5 THEN 'Insufficient data: only ' || p.n || ' points'
    WHEN x.max_z_score IS NULL THEN 'Feature engineering produced empty result' END AS error
FROM labelled_events e
LEFT JOIN (SELECT region_id, COUNT(*) AS n FROM event_rows GROUP BY 1) p ON p.region_id = e.name
LEFT JOIN (SELECT region_id, ROUND_EVEN(MAX(chl_a_value), 2) AS max_chl_a, ROUND_EVEN(MAX(ABS(z_score)), 2) AS max_z_score FROM event_detections GROUP BY 1) x ON x.region_id = e.name
LEFT JOIN (SELECT g.name, MAX(CASE d.severity WHEN 'moderate' THEN 1 WHEN 'severe' THEN 2 ELSE 3 END) AS worst
  FROM labelled_events g JOIN event_detections d ON d.region_id = g.name AND d.severity <> 'none' AND ABS(date_diff('day', g.date, d.date)) <= 30 AND {haversine('g.lat', 'g.lon', 'd.lat', 'd.lon')} <= 50
  GROUP BY 1) m ON m.name = e.name"""),
}


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the views it names and those they build on.

    SQL that starts with a comma brings further views of its own.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered) + "\n" + sql.strip()
