"""Table and report schemas. Every read declares its schema; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

NUMERIC_INPUTS = [
    "chl_a", "turbidity", "sst_delta", "precipitation_7d", "wind_speed", "cloud_fraction",
]

OBSERVATION = _struct(
    ("region_id", S), ("date", T.DateType()), ("lat", D), ("lon", D),
    *[(name, D) for name in NUMERIC_INPUTS], ("source", S),
)

DETECTION_COLUMNS = [
    "region_id", "cell_id", "date", "lat", "lon", "severity", "confidence", "chl_a_value",
    "chl_a_baseline", "z_score", "weather_context", "event_id",
]

MAP_ELEMENT = _struct(
    ("id", L), ("type", S), ("lat", D), ("lon", D),
    ("center", _struct(("lat", D), ("lon", D))),
    ("tags", T.MapType(S, S)),
)
MAP_RESPONSE = _struct(("elements", T.ArrayType(MAP_ELEMENT)))

# Nested coordinates differ in depth by geometry type, so they are read as text.
GEOMETRY = _struct(("type", S), ("coordinates", S))
FEATURE_A = _struct(("id", S), ("properties", _struct(("datetime", S))), ("geometry", GEOMETRY))
PRODUCT_B = _struct(
    ("Id", S), ("ProductType", S), ("ContentDate", _struct(("Start", S))), ("GeoFootprint", GEOMETRY), ("Footprint", S),
)
RESPONSE = _struct(("region_id", L))
CATALOG_A = _struct(("region_id", L), ("features", T.ArrayType(FEATURE_A)))
CATALOG_B = _struct(("region_id", L), ("value", T.ArrayType(PRODUCT_B)))

ADDRESS = _struct(("city", S), ("town", S), ("county", S), ("state", S), ("country", S))
PLACE = _struct(("name", S), ("display_name", S), ("address", ADDRESS))

PROBABLE_SOURCE = _struct(
    ("source_name", S), ("source_type", S), ("likelihood", S), ("evidence", S),
    ("distance_km", D), ("coordinates", T.ArrayType(D)),
)
DRINKING_WATER_IMPACT = _struct(
    ("at_risk_communities", T.ArrayType(S)), ("estimated_arrival_hours", D),
    ("contaminant_type", S), ("who_threshold_exceeded", B), ("recommended_monitoring", S),
)
RECOMMENDED_ACTION = _struct(("priority", S), ("action", S), ("responsible_party", S))
COMMUNITY_REPORT = _struct(
    ("alert_level", S), ("alert_summary", S),
    ("probable_sources", T.ArrayType(PROBABLE_SOURCE)),
    ("drinking_water_impact", DRINKING_WATER_IMPACT),
    ("recommended_actions", T.ArrayType(RECOMMENDED_ACTION)),
    ("historical_context", S),
    ("metadata", T.MapType(S, S)),
)

GROUND_TRUTH = _struct(
    ("name", S), ("lat", D), ("lon", D), ("date", T.DateType()), ("bloom_confirmed", B),
)
