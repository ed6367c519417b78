"""Range joins on the sphere, as equi-joins on grid bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.geo import SphereGrid, haversine_km


#: Stored keys of a bin that stand in one row.
KEYS_PER_LIST = 500


def within_radius(
    probe: DataFrame, build: DataFrame, radius_km: float, keys: Sequence[str] = (), bins_across: float = 3.0
) -> DataFrame:
    """Pairs of rows at most ``radius_km`` apart, with their ``distance_km``.

    ``probe`` has ``probe_lat``/``probe_lon`` and is copied to the bins its disc touches; ``build``
    has ``lat``/``lon`` and is binned once. The distance is checked exactly afterwards. Skewed bins
    are split by adaptive execution, since the join is an ordinary equi-join.
    """
    grid = SphereGrid(2.0 * radius_km / bins_across)
    left = grid.cover(probe, "probe_lat", "probe_lon", radius_km, bins_across)
    right = build.withColumn("_bin", grid.bin(F.col("lat"), F.col("lon")))
    distance = haversine_km(F.col("probe_lat"), F.col("probe_lon"), F.col("lat"), F.col("lon"))
    return (
        left.join(right, [*keys, "_bin"])
        .withColumn("distance_km", distance)
        .where(F.col("distance_km") <= radius_km)
        .drop("_bin")
    )


def within_box(
    rows: DataFrame, requests: DataFrame, delta: float = 0.5, days: int | None = None
) -> DataFrame:
    """Rows inside the latitude/longitude box (and date window) of each request.

    ``requests`` has ``request_lat``, ``request_lon`` and, with ``days``, ``request_date``. Boxes
    touch at most 2 x 2 bins of their own width.
    """
    width = 2.0 * delta

    def span(centre: str) -> Column:
        return F.sequence(
            F.floor((F.col(centre) - delta) / width), F.floor((F.col(centre) + delta) / width)
        )

    boxes = requests.withColumn("_lat_bin", F.explode(span("request_lat"))).withColumn(
        "_lon_bin", F.explode(span("request_lon"))
    )
    binned = rows.withColumns(
        {"_lat_bin": F.floor(F.col("lat") / width), "_lon_bin": F.floor(F.col("lon") / width)}
    )
    inside = F.col("lat").between(F.col("request_lat") - delta, F.col("request_lat") + delta) & F.col(
        "lon"
    ).between(F.col("request_lon") - delta, F.col("request_lon") + delta)
    if days is not None:
        inside &= F.col("date").between(
            F.date_sub("request_date", days), F.date_add("request_date", days)
        )
    return binned.join(boxes, ["_lat_bin", "_lon_bin"]).where(inside).drop("_lat_bin", "_lon_bin")


def nearby_keys(requests: DataFrame, keys: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """For each request the stored key within the tolerance in both coordinates, best first.

    ``requests`` has ``request_id, request_lat, request_lon, request_key``; ``keys`` has
    ``cache_key, lat, lon``. An exact key wins, then the closest, then the smallest key. The keys of a
    bin of twice the tolerance travel as lists of bounded length, so a request gives one row per list
    of the bins it touches, two by two mostly, and not one per key near it.
    """
    width = 2.0 * tolerance
    bins = ["_lat_bin", "_lon_bin"]
    stored = keys.select("cache_key", "lat", "lon").distinct()
    binned = stored.withColumns({"_lat_bin": F.floor(F.col("lat") / width), "_lon_bin": F.floor(F.col("lon") / width)})
    listed = binned.withColumn("_list", F.floor((rank_within(bins, "cache_key", "lat", "lon") - 1) / KEYS_PER_LIST))
    lists = listed.groupBy(*bins, "_list").agg(F.collect_list(F.struct("cache_key", "lat", "lon")).alias("_keys"))

    def span(centre: str) -> Column:
        return F.sequence(F.floor((F.col(centre) - tolerance) / width), F.floor((F.col(centre) + tolerance) / width))

    asked = requests.select("request_id", "request_lat", "request_lon", "request_key")
    asked = asked.withColumn("_lat_bin", F.explode(span("request_lat"))).withColumn("_lon_bin", F.explode(span("request_lon")))

    def inside(key: Column) -> Column:
        def near(own: str, centre: str) -> Column:
            at = F.col(centre)
            return key[own].between(at - tolerance, at + tolerance) & (F.abs(key[own] - at) <= tolerance)

        return near("lat", "request_lat") & near("lon", "request_lon")

    def ranked(key: Column) -> Column:
        dlat, dlon = key["lat"] - F.col("request_lat"), key["lon"] - F.col("request_lon")
        other = F.when(key["cache_key"] == F.col("request_key"), 0).otherwise(1)
        return F.struct(other.alias("other"), (dlat * dlat + dlon * dlon).alias("square"), *(key[c].alias(c) for c in ("cache_key", "lat", "lon")))

    best = F.array_min(F.transform(F.filter("_keys", inside), ranked))
    # chosen before rows are sorted by request, so the lists don't take part in that
    chosen = asked.join(lists, bins).select("request_id", best.alias("hit"))
    found = chosen.groupBy("request_id").agg(F.min("hit").alias("hit")).where("hit IS NOT NULL")
    return found.select("request_id", "hit.cache_key", "hit.lat", "hit.lon", (F.col("hit.other") == 0).alias("exact"))


def rank_within(keys: Sequence[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
