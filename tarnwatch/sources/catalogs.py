"""Product catalogs: which products cover a region, and which dates it has products for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwatch import schemas
from tarnwatch.operators import footprints
from tarnwatch.operators.nearby import rank_within
from tarnwatch.session import stage
from tarnwatch.sources import jsonarrays

# Fixed values, defaults of product_dates: newest products looked at per region and catalog; dates
# that make A sufficient.
NEWEST_A, NEWEST_B = 200, 100
ENOUGH_DATES = 10
PRODUCT_TYPE_B = "OL_2_WFR___"


def _responses(spark: SparkSession, path: str, array: str, element: StructType, whole: StructType, split: bool) -> DataFrame:
    if split:
        return jsonarrays.read_array(spark, path, array, element, schemas.RESPONSE)
    raw = spark.read.schema(whole).option("multiLine", True).json(path)
    return raw.select("region_id", F.explode(array).alias("element"))


def read_catalog_a(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Products of catalog A: one row per feature with its timestamp text and its footprint.

    A large response is read by many tasks; ``split=False`` reads each file as a whole.
    """
    rows = _responses(spark, path, "features", schemas.FEATURE_A, schemas.CATALOG_A, split)
    return rows.select(
        "region_id", F.col("element.id").alias("product_id"), F.col("element.properties.datetime").alias("product_time"),
        footprints.polygons_of(F.col("element.geometry")).alias("footprint"),
    )


def read_catalog_b(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Products of catalog B, of the water product type; ``split`` as for catalog A.

    The footprint is the GeoJSON one, else the well-known text.
    """
    rows = _responses(spark, path, "value", schemas.PRODUCT_B, schemas.CATALOG_B, split)
    geometry = F.coalesce(F.col("element.GeoFootprint"), footprints.geometry_of_text(F.col("element.Footprint")))
    return rows.where(F.col("element.ProductType") == PRODUCT_TYPE_B).select(
        "region_id", F.col("element.Id").alias("product_id"), F.col("element.ContentDate.Start").alias("product_time"),
        footprints.polygons_of(geometry).alias("footprint"),
    )


def products_in_boxes(products: DataFrame, regions: DataFrame, delta: float = 0.5) -> DataFrame:
    """``region_id, product_id, product_time`` of the products whose footprint meets a region's box.

    ``regions`` has ``region_id, lat, lon``. Each product counts once per region, however often it is
    listed. The result takes the place of a catalog in :func:`product_dates` and the others here.
    """
    found = footprints.meeting_boxes(products.select("product_id", "product_time", "footprint"), regions, delta)
    return found.select("region_id", "product_id", "product_time")


def newest(products: DataFrame, limit: int, since: str | None = None) -> DataFrame:
    """The newest products of each region.

    The ranked filter runs on the map side too, so a region with most of the products sends at
    most ``limit`` rows per task.
    """
    rows = products if since is None else products.where(F.col("product_time") >= since)
    place = rank_within(["region_id"], F.desc("product_time"), F.desc("product_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def product_dates(
    catalog_a: DataFrame, catalog_b: DataFrame, since: str | None = None,
    newest_a: int = NEWEST_A, newest_b: int = NEWEST_B, enough: int = ENOUGH_DATES,
) -> DataFrame:
    """Distinct product dates: those of A, plus those of B where A has fewer than ``enough``.

    Only the ``newest_a`` and ``newest_b`` newest products of a region are looked at.
    """

    def dates(products: DataFrame, limit: int) -> DataFrame:
        kept = newest(products, limit, since).where(F.coalesce("product_time", F.lit("")) != "")
        return kept.select("region_id", F.substring("product_time", 1, 10).alias("date")).distinct()

    # the dates of A are read twice
    a, b = stage(dates(catalog_a, newest_a), "product-dates"), dates(catalog_b, newest_b)
    sufficient = a.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
    added = b.join(sufficient, "region_id", "left_anti")
    return a.unionByName(added).distinct().withColumn("date", F.to_date("date"))


def weekly_dates(dates: DataFrame) -> DataFrame:
    """First date of each ISO week of each region."""
    return dates.groupBy(
        "region_id",
        F.extract(F.lit("YEAROFWEEK"), F.col("date")).alias("iso_year"),
        F.weekofyear("date").alias("iso_week"),
    ).agg(F.min("date").alias("date"))


def regions_with_products(regions: DataFrame, catalog_a: DataFrame, catalog_b: DataFrame) -> DataFrame:
    """Regions that have products in A or B."""
    known = catalog_a.select("region_id").unionByName(catalog_b.select("region_id")).distinct()
    return regions.join(known, "region_id", "left_semi")


def regions_without_products(regions: DataFrame, catalog_a: DataFrame, catalog_b: DataFrame) -> DataFrame:
    known = catalog_a.select("region_id").unionByName(catalog_b.select("region_id")).distinct()
    return regions.join(known, "region_id", "left_anti")
