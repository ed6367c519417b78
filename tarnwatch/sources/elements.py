"""Mapped elements (nodes and ways with tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch import schemas
from tarnwatch.sources import jsonarrays


def read_elements(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Elements of stored map responses, one row each.

    A large response is read by many tasks; ``split=False`` reads each file as a whole.
    """
    if split:
        rows = jsonarrays.read_array(spark, path, "elements", schemas.MAP_ELEMENT).withColumnRenamed("element", "e")
    else:
        raw = spark.read.schema(schemas.MAP_RESPONSE).option("multiLine", True).json(path)
        rows = raw.select(F.explode("elements").alias("e"))
    return rows.select(
        F.col("e.id").alias("element_id"), F.col("e.type").alias("element_type"),
        "e.lat", "e.lon", "e.center", "e.tags",
    )
