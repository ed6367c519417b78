"""Logical inputs of the operators, derived from the driver's tables.

Each view has a twin in :mod:`tarnwatch.plans.sqlviews`; the text there defines the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from tarnwatch.operators.detect import ensemble
from tarnwatch.operators.features import compute_features
from tarnwatch.operators.spatial import spatial_votes
from tarnwatch.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    """Sum of a two-decimal amount in whole cents: exact, whatever the order."""
    return F.sum(F.round(F.col(column) * 1e2).cast("long")).cast("double")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per supplier, one row per cell and week."""
    supplier = F.col("cell_id")
    n = F.col("_n")
    weekly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("cell_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            _cents("l_extendedprice").alias("_price"),
            F.sum("l_quantity").alias("_quantity"),
            _cents("l_tax").alias("_tax"),
            _cents("l_discount").alias("_discount"),
        )
    )
    region = F.floor(supplier / 1e2)
    return weekly.select(
        region.alias("region_id"),
        "date",
        F.round(3e1 + (supplier % 10) * 5e-2 + (region % 12) * 5e0, 4).alias("lat"),
        F.round(
            -8e1 + (F.floor(supplier / 1e1) % 10) * 5e-2 + (F.floor(supplier / 12e2) % 50) * 5e0, 4
        ).alias("lon"),
        "cell_id",
        (F.floor(F.col("_price") / n / 1e5 * 1024e0) / 1024e0).alias("chl_a"),
        (F.col("_quantity") / n * 15e-2).alias("turbidity"),
        (F.col("_tax") / n - 4e0).alias("sst_delta"),
        F.col("_quantity").alias("precipitation_7d"),
        (F.col("_discount") / n).alias("wind_speed"),
    )


def with_arrival(rows: DataFrame) -> DataFrame:
    """Arrival numbers as in files read cell after cell."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    return rows.withColumn("ordinal", F.col("cell_id") * 100000 + day)


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as text, with unreadable dates, unusable values and gaps."""
    k = F.floor(F.col("chl_a") * 1024e0)
    return with_arrival(observations(spark, sf_dir)).select(
        "region_id",
        "cell_id",
        "ordinal",
        F.when(k % 50 == 7, "bad-date")
        .otherwise(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
        .alias("time"),
        (F.col("lat") + 3e-5).cast("string").alias("latitude"),
        (F.col("lon") + 3e-5).cast("string").alias("longitude"),
        F.when(k % 20 == 3, "NaN").when(k % 20 == 4, "-1.0").when(k % 20 == 5, "412.0")
        .when(k % 20 == 6, "n/a").otherwise(F.col("chl_a").cast("string")).alias("chlorophyll"),
        F.when(k % 7 != 0, F.col("turbidity")).alias("turbidity"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_features(observations(spark, sf_dir))


def with_stand_in(rows: DataFrame) -> DataFrame:
    """A fixed rule in place of the isolation forest, so that SQL can follow the vote."""
    far = (F.abs("chl_a_seasonal_residual") > 35) | (F.abs("chl_a_delta_1w") > 60)
    return rows.withColumn("iso_flag", F.when(far, 1e0).otherwise(0e0))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the stand-in flag, staged for the consumers that read them repeatedly."""
    return stage(with_stand_in(features(spark, sf_dir)), "features")


def detections(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    return ensemble(spatial_votes(stored_features(spark, sf_dir)), exact=exact)


def facility_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and ways, one per part, in clusters of a thousand spread over the globe."""
    key = F.col("p_partkey")
    cluster = F.floor(key / 1e3)
    lat = F.round(-58e0 + (cluster % 58) * 2e0 + (key % 50) * 4e-3, 4)
    lon = F.round(-17e1 + (F.floor(cluster / 58e0) % 85) * 4e0 + (key % 40) * 6e-3, 4)
    node, kind = key % 3 != 0, F.col("p_size") % 8
    tags = {
        "name": F.when(key % 4 != 0, F.col("p_name")),
        "man_made": F.when(kind == 0, "wastewater_plant").when(kind == 4, "works"),
        "industrial": F.when(kind == 1, "chemical").when(kind == 2, "slaughterhouse"),
        "amenity": F.when(kind == 3, "waste_disposal"),
        "landuse": F.when(kind == 5, "industrial").when(kind == 6, "farmland"),
        "craft": F.when(kind == 7, F.lower("p_type")),
        "operator": F.col("p_brand"),
    }
    pairs = F.create_map(*[part for name, value in tags.items() for part in (F.lit(name), value)])
    return table(spark, sf_dir, "part").select(
        key.alias("element_id"),
        F.when(node, "node").otherwise("way").alias("element_type"),
        F.when(node, lat).alias("lat"),
        F.when(node, lon).alias("lon"),
        F.when(~node, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        F.map_filter(pairs, lambda name, value: value.isNotNull()).alias("tags"),
    )


def anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per supplier, in the neighbourhood of the facility clusters."""
    key = F.col("s_suppkey")
    cluster = F.floor(key / 5e1)
    chl = F.floor(F.abs("s_acctbal")) / 128e0
    return table(spark, sf_dir, "supplier").select(
        key.alias("event_id"),
        F.format_string("r%d", cluster).alias("region_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 2000).cast("int")).alias("date"),
        F.round(
            -58e0 + (cluster % 58) * 2e0 + (key % 10) * 5e-2
            + F.when(key % 10 >= 7, 2e-1).otherwise(0e0), 4
        ).alias("lat"),
        F.round(
            -17e1 + (F.floor(cluster / 58e0) % 85) * 4e0 + (F.floor(key / 1e1) % 5) * 5e-2
            + F.when(key % 25 == 0, 2e0).otherwise(0e0), 4
        ).alias("lon"),
        F.when(key % 3 == 0, "critical").when(key % 3 == 1, "severe").otherwise("moderate").alias("severity"),
        F.lit(7e-1).alias("confidence"),
        chl.alias("chl_a_value"),
        (chl / 4e0).alias("chl_a_baseline"),
        ((key % 40) / 8e0).alias("z_score"),
        F.when(key % 4 == 0, "post_rainfall_runoff").when(key % 4 == 1, "wind_driven_resuspension")
        .otherwise("calm_conditions").alias("weather_context"),
    )


def product_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalog A from open orders, catalog B from filled ones; the region is the customer."""
    products = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("region_id"),
        F.col("o_orderkey").alias("product_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("product_time"),
        "o_orderstatus",
    )
    a = products.where(F.col("o_orderstatus") == "O").drop("o_orderstatus")
    b = products.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    return a, b


ROUTING = [
    (f"src{i}", "permits" if i < 6 else "agriculture" if i < 12 else "watershed") for i in range(18)
]


def routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    routing = spark.createDataFrame(
        [(source, f"{collection}_notes", collection) for source, collection in ROUTING],
        "source string, document_type string, collection string",
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return documents.join(F.broadcast(routing), "source")  # a fixed list: documents are not shuffled


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled event per nation on the observation grid; some far away, some out of time."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        F.round(3e1 + (key % 10) * 5e-2 + F.when(key % 5 == 4, 3e0).otherwise(0e0), 4).alias("lat"),
        F.round(-8e1 + (key % 10) * 5e-2, 4).alias("lon"),
        F.date_add(F.lit("1995-03-01").cast("date"), key * 90 + F.when(key % 7 == 6, 4000).otherwise(0)).alias("date"),
        (key % 3 != 0).alias("bloom_confirmed"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3).alias("collection"), "label", "embedding"
    )


def mean_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean embedding of each group, summed on the map side."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return rows.groupBy(*keys).agg(mean.alias("_mean")).select(
        *keys, vector_to_array("_mean").alias("embedding")
    )


def _tile_place(key):
    """A position that depends on a number, spread over the globe in steps of an eighth of a degree."""
    lat = key % 160 - 8e1 + (key % 7) / 8e0
    lon = (key * 37) % 360 - 18e1 + (key % 5) / 8e0
    return lat, lon


def tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order line: a cell per part, a region per 25 parts."""
    key = F.col("l_partkey")
    lat, lon = _tile_place(key)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.floor(key / 25).cast("string")).alias("region_id"), F.to_date("l_shipdate").alias("date"),
        lat.alias("lat"), lon.alias("lon"), (F.floor("l_extendedprice") / 1024e0).alias("chl_a"),
        F.col("l_quantity").cast("double").alias("turbidity"), F.col("l_returnflag").alias("source"),
    )


def tile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per supplier, at or up to half a degree from the cell of some part."""
    key = F.col("s_suppkey")
    lat, lon = _tile_place(key * 13)
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("e"), key.cast("string")).alias("name"),
        (lat + (key % 5 - 2) / 4e0).alias("lat"), (lon + (key % 3 - 1) / 2e0).alias("lon"),
        F.date_add(F.lit("1992-03-01").cast("date"), ((key * 23) % 2400).cast("int")).alias("date"),
    )


#: Products or elements of one written response.
PAGE = 100


def write_responses(items: DataFrame, array: str, path: str) -> None:
    """JSON objects (``key``, text ``item``) as responses of a page of keys each, several in a file."""
    pages = items.groupBy(F.floor(F.col("key") / PAGE)).agg(F.array_sort(F.collect_list("item")).alias("items"))
    text = F.concat(F.lit(f'{{"{array}":['), F.array_join("items", ",\n"), F.lit("]}"))
    pages.select(text.alias("value")).write.text(path)


def footprint_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per order with a slanted footprint; some have a hole, a second part, or cross 180 degrees."""
    key = F.col("o_orderkey")
    x, y = (key * 7919 % 23040) / 64e0 - 18e1, (key * 104729 % 9600) / 64e0 - 75e0
    width, height, slant = (key % 9 + 4).cast("double"), (key % 7 + 3).cast("double"), (key % 5 - 2).cast("double")
    wrapped = lambda lon: F.when(lon >= 180, lon - 360).otherwise(lon)
    ring = lambda *points: F.array(*(F.array(wrapped(a), b) for a, b in points))
    outer = ring((x, y), (x + width, y + 1), (x + width + slant, y + height + 1), (x + slant, y + height), (x, y))
    cx, cy = x + width / 2 + slant / 2, y + (height + 1) / 2
    hole = ring((cx - 1, cy), (cx, cy + 1), (cx + 1, cy), (cx, cy - 1), (cx - 1, cy))
    second = F.array(ring((x + 30, y), (x + 32, y), (x + 32, y + 2), (x + 30, y + 2), (x + 30, y)))
    first = F.when(key % 11 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return table(spark, sf_dir, "orders").select(
        key.alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        first.alias("first"), F.when(key % 7 == 0, second).alias("second"),
    )


def _geometry() -> F.Column:
    several = F.col("second").isNotNull()
    return F.struct(
        F.when(several, "MultiPolygon").otherwise("Polygon").alias("type"),
        F.when(several, F.to_json(F.array("first", "second"))).otherwise(F.to_json("first")).alias("coordinates"),
    )


def _well_known_text() -> F.Column:
    """The footprint as well-known text; numbers are written as in JSON."""
    several = F.col("second").isNotNull()
    text = F.when(several, F.to_json(F.array("first", "second"))).otherwise(F.to_json("first"))
    points = F.regexp_replace(text, r"\[(-?[0-9.E-]+),(-?[0-9.E-]+)\]", "$1 $2")
    name = F.when(several, "MULTIPOLYGON").otherwise("POLYGON")
    return F.concat(F.lit("geography'SRID=4326;"), name, F.lit(" "), F.translate(points, "[]", "()"), F.lit("'"))


def written_catalogs(spark: SparkSession, sf_dir: str, path: str) -> tuple[str, str]:
    """Catalog A (even orders, GeoJSON) and B (odd orders, some with well-known text) as responses."""
    rows = footprint_products(spark, sf_dir)
    shaped = rows.select("*", _geometry().alias("g")).select("*", "g.*")
    json = F.concat(F.lit('{"type":"'), "type", F.lit('","coordinates":'), "coordinates", F.lit("}"))
    key, quoted = F.col("key").cast("string"), lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    item_a = F.concat(F.lit("{"), quoted("id", key), F.lit(',"properties":{'), quoted("datetime", F.col("time")), F.lit('},"geometry":'), json, F.lit("}"))
    kind = F.when(F.col("key") % 10 == 1, "OTHER").otherwise("OL_2_WFR___")
    shape = F.when(F.col("key") % 3 == 0, quoted("Footprint", _well_known_text())).otherwise(F.concat(F.lit('"GeoFootprint":'), json))
    item_b = F.concat(F.lit("{"), quoted("Id", key), F.lit(","), quoted("ProductType", kind), F.lit(',"ContentDate":{'), quoted("Start", F.col("time")), F.lit("},"), shape, F.lit("}"))
    for name, rest, item, array in (("a", 0, item_a, "features"), ("b", 1, item_b, "value")):
        write_responses(shaped.where(F.col("key") % 2 == rest).select("key", item.alias("item")), array, f"{path}/{name}")
    return f"{path}/a", f"{path}/b"


def box_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per supplier; every tenth lies at the antimeridian."""
    key = F.col("s_suppkey")
    lon = F.when(key % 10 == 0, 179.75).when(key % 10 == 5, -179.875).otherwise((key * 53) % 360 - 18e1 + (key % 4) / 4e0)
    return table(spark, sf_dir, "supplier").select(
        key.cast("long").alias("region_id"), ((key * 37) % 140 - 7e1 + (key % 8) / 8e0).alias("lat"), lon.alias("lon")
    )
