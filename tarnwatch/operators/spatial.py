"""Spatial evidence: how many other anomalous observations lie near an anomalous one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.geo import SphereGrid, haversine_km


def spatial_votes(
    features: DataFrame,
    z: str = "chl_a_zscore",
    radius_km: float = 10.0,
    min_neighbors: int = 2,
    same_date: bool = False,
) -> DataFrame:
    """Add ``spatial_flag``: 1.0 where abs(z) > 2 and enough neighbours have abs(z) > 1.5.

    Neighbours are other rows of the region within the radius; other dates of the same cell count
    unless ``same_date`` is set.

    Rows are first counted per site, so pairs are formed between sites and never between rows.
    Grid bins are small enough that all points of a bin are neighbours of each other: a bin with
    enough hot rows settles its sites by its own total. What is left for the distance join are the
    sites of bins with at most ``min_neighbors`` hot rows, so a crowded bin is only ever probed by
    the few sites around it and the number of pairs stays linear in the number of sites.

    ``features`` is read three times, so it should be a stored table.
    """
    grid_km = 0.999 * radius_km / math.sqrt(2.0)
    grid = SphereGrid(grid_km)
    scope = ["region_id", "date"] if same_date else ["region_id"]
    site = [*scope, "cell_id"]
    size = F.abs(F.coalesce(F.col(z), F.lit(0.0)))
    needed = min_neighbors + 1

    sites = (
        features.where(size > 1.5)
        .groupBy(*site)
        .agg(
            F.min("lat").alias("_lat"),
            F.min("lon").alias("_lon"),
            F.count(F.lit(1)).alias("_hot"),
            F.count_if(size > 2).alias("_probes"),
        )
        .withColumn("_bin", grid.bin(F.col("_lat"), F.col("_lon")))
    )
    counted = sites.withColumn(
        "_in_bin", F.sum("_hot").over(Window.partitionBy(*scope, "_bin"))
    )
    settled = counted.where((F.col("_probes") > 0) & (F.col("_in_bin") >= needed)).select(*site)

    unsettled = counted.where((F.col("_probes") > 0) & (F.col("_in_bin") < needed)).select(
        *site, F.col("_lat").alias("_plat"), F.col("_lon").alias("_plon")
    )
    open_sites = grid.cover(unsettled, "_plat", "_plon", radius_km, 2.0 * radius_km / grid_km)
    around = sites.select(*scope, "_bin", "_lat", "_lon", "_hot")
    found = (
        open_sites.join(around, [*scope, "_bin"])
        .where(
            haversine_km(F.col("_plat"), F.col("_plon"), F.col("_lat"), F.col("_lon")) <= radius_km
        )
        .groupBy(*site)
        .agg(F.sum("_hot").alias("_near"))
        .where(F.col("_near") >= needed)
        .select(*site)
    )
    flagged = settled.unionByName(found).withColumn("_near_enough", F.lit(True))
    # Only rows that can be flagged take part in the join; the others never leave their partition.
    probes = features.where(size > 2).join(flagged, site, "left")
    probes = probes.withColumn("spatial_flag", F.when(F.col("_near_enough"), 1.0).otherwise(0.0))
    rest = features.where(size <= 2).withColumn("spatial_flag", F.lit(0.0))
    return rest.unionByName(probes.drop("_near_enough"))
