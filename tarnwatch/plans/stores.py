"""Queries that write stores and files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions import text
from tarnwatch.operators import chunks
from tarnwatch.plans import views
from tarnwatch.plans.registry import query
from tarnwatch.session import stage, staging_dir
from tarnwatch.sources import buckets, catalogs, documents, elements, gridded, obstore

#: Buckets of the stores that queries write.
STORE_BUCKETS = 16


def fresh(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tile_store(spark: SparkSession, sf_dir: str) -> buckets.BucketStore:
    """All observations stored, then some years of every fourth region overwritten."""
    store = obstore.open_store(spark, fresh(spark, "tiles"), STORE_BUCKETS)
    rows = views.tile_rows(spark, sf_dir)
    obstore.overwrite_regions(store, rows)
    number = F.substring("region_id", 2, 20).cast("long")
    revised = rows.where((F.col("turbidity") > 10) & (number % 4 == 0) & (F.year("date") >= 1995))
    obstore.overwrite_regions(store, revised.withColumn("chl_a", F.col("chl_a") + 1))
    return store


@query("SELECT region_id, date, lat, lon, chl_a, turbidity, source FROM tile_store", ("tile_store",))
def region_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored observations after some regions' years were overwritten."""
    return obstore.observations(_tile_store(spark, sf_dir)).select("region_id", "date", "lat", "lon", "chl_a", "turbidity", "source")


@query("""
SELECT region_id, COUNT(*) AS data_points, MIN(date) AS first_date, MAX(date) AS last_date, MIN(lat) AS south, MIN(lon) AS west, MAX(lat) AS north, MAX(lon) AS east
FROM tile_store GROUP BY region_id""", ("tile_store",))
def region_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored regions with their rows, dates and extent, from the store's summaries."""
    return obstore.stored_regions(_tile_store(spark, sf_dir))


@query("""
SELECT e.name, COUNT(t.date) AS n_rows, COUNT(DISTINCT t.region_id) AS n_regions, MIN(t.date) AS first_date, MAX(t.date) AS last_date, SUM(t.chl_a) AS total_chl_a
FROM tile_events e LEFT JOIN tile_store t ON t.lat BETWEEN e.lat - 5e-1 AND e.lat + 5e-1 AND t.lon BETWEEN e.lon - 5e-1 AND e.lon + 5e-1
  AND t.date BETWEEN e.date - 60 AND e.date + 60
GROUP BY e.name""", ("tile_store", "tile_events"))
def stored_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds around each event, read from the files of its places and years only."""
    events = views.tile_events(spark, sf_dir)
    found = obstore.around_events(_tile_store(spark, sf_dir), events)
    sums = found.groupBy(F.col("event").alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("region_id").alias("n_regions"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("chl_a").alias("total_chl_a"),
    )
    filled = events.select("name").join(sums, "name", "left")
    return filled.fillna(0, ["n_rows", "n_regions"])


@query("""
SELECT collection, chunk_id, CAST(CASE quality WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS ordinal,
  md5(CASE quality WHEN 1 THEN 'revised 2: ' WHEN 0 THEN 'late: ' ELSE '' END || chunk) AS digest
FROM (SELECT r.collection, c.source || '_' || c.doc_id || printf('_%04d', c.chunk_index) AS chunk_id, c.chunk, l.quality
  FROM chunks c JOIN routed r USING (doc_id) LEFT JOIN (SELECT doc_id, MIN(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)) x""", ("chunks", "routed"))
def collection_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored, revised twice in one batch, and overtaken by a late batch."""
    labels = views.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = chunks.fixed_chunks(views.routed_documents(spark, sf_dir).join(labels, "doc_id", "left"))
    file_name = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    rows = stage(rows.select("quality", "collection", text.chunk_id(file_name, F.col("chunk_index")).alias("chunk_id"), "chunk"), "chunks")
    store = documents.open_collections(spark, fresh(spark, "collections"), STORE_BUCKETS)
    documents.upsert_chunks(store, rows.withColumn("ordinal", F.lit(0)))
    twice = rows.where("quality = 1").withColumn("ordinal", F.explode(F.array(F.lit(2), F.lit(1))))
    documents.upsert_chunks(store, twice.withColumn("chunk", F.concat(F.lit("revised "), F.col("ordinal").cast("string"), F.lit(": "), "chunk")))
    late = rows.where("quality IS NOT NULL").withColumn("ordinal", F.lit(1))
    documents.upsert_chunks(store, late.withColumn("chunk", F.concat(F.lit("late: "), "chunk")))
    return store.read().select("collection", "chunk_id", "ordinal", F.md5("chunk").alias("digest"))


def _box_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the written catalogs have for the regions' boxes."""
    a, b = views.written_catalogs(spark, sf_dir, fresh(spark, "catalogs"))
    regions = views.box_regions(spark, sf_dir)
    return tuple(catalogs.products_in_boxes(c, regions) for c in (catalogs.read_catalog_a(spark, a), catalogs.read_catalog_b(spark, b)))


@query("SELECT region_id, CAST(product_id AS VARCHAR) AS product_id, product_time, CASE product_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS catalog FROM box_hits", ("box_hits",))
def catalog_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of both catalogs whose footprint meets a region's box."""
    a, b = _box_catalogs(spark, sf_dir)
    return a.withColumn("catalog", F.lit("a")).unionByName(b.withColumn("catalog", F.lit("b")))


@query("""
, a AS (SELECT DISTINCT region_id, CAST(SUBSTRING(product_time, 1, 10) AS DATE) AS date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY product_time DESC, CAST(product_id AS VARCHAR) DESC) AS rn FROM box_hits WHERE product_id % 2 = 0) x WHERE rn <= 4),
b AS (SELECT DISTINCT region_id, CAST(SUBSTRING(product_time, 1, 10) AS DATE) AS date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY product_time DESC, CAST(product_id AS VARCHAR) DESC) AS rn FROM box_hits WHERE product_id % 2 = 1) x WHERE rn <= 3)
SELECT * FROM a UNION SELECT * FROM b WHERE region_id NOT IN (SELECT region_id FROM a GROUP BY region_id HAVING COUNT(*) >= 4)""", ("box_hits",))
def catalog_box_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dates of the boxes: the newest four of catalog A, and three of B where A has fewer dates."""
    return catalogs.product_dates(*_box_catalogs(spark, sf_dir), newest_a=4, newest_b=3, enough=4)


@query("""
SELECT element_id, element_type, CASE element_type WHEN 'node' THEN lat END AS lat, CASE element_type WHEN 'node' THEN lon END AS lon,
  CASE element_type WHEN 'way' THEN lat END AS center_lat, CASE element_type WHEN 'way' THEN lon END AS center_lon, name, operator
FROM elements""", ("elements",))
def map_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements written as responses and read back, each response by any number of tasks."""
    path = fresh(spark, "responses")
    rows = views.facility_elements(spark, sf_dir).withColumnsRenamed({"element_id": "id", "element_type": "type"})
    views.write_responses(rows.select(F.col("id").alias("key"), F.to_json(F.struct(*rows.columns)).alias("item")), "elements", path)
    found = elements.read_elements(spark, path)
    return found.select(
        "element_id", "element_type", "lat", "lon", F.col("center.lat").alias("center_lat"), F.col("center.lon").alias("center_lon"),
        F.col("tags")["name"].alias("name"), F.col("tags")["operator"].alias("operator"),
    )


@query("SELECT region_id, date, lat, lon, chl_a, CASE source WHEN 'R' THEN turbidity END AS turbidity FROM (SELECT *, CAST(SUBSTRING(region_id, 2) AS BIGINT) AS n FROM tile_rows) t WHERE chl_a > 0 AND chl_a < 300",
       ("tile_rows",))
def mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded files of three kinds of headers in one folder, read by name."""
    path, rows = fresh(spark, "mixed"), views.tile_rows(spark, sf_dir)
    kinds = {
        "A": ["region_id", "time", "latitude", "longitude", "chlorophyll"],
        "N": ["Chlor_A", "Longitude", "Latitude", "Time_UTC", "region_id"],
        "R": ["region_id", "time", "lat", "lon", "chlor_a", "turbidity"],
    }
    names = {"region_id": "region_id", "turbidity": "turbidity"}
    for kind, header in kinds.items():
        columns = [names.get(h) or next(c for part, c in (("time", "date"), ("lat", "lat"), ("lon", "lon"), ("chlor", "chl_a")) if part in h.lower()) for h in header]
        rows.where(F.col("source") == kind).select(*(F.col(c).cast("string").alias(h) for c, h in zip(columns, header))).write.mode("append").option("header", True).csv(path)
    found = gridded.read_gridded_csv(spark, path)
    return found.select("region_id", "date", "lat", "lon", "chl_a", F.col("turbidity").cast("double").alias("turbidity"))
