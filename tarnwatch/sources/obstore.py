"""The observation store: places in hashed buckets, rows along a space-filling curve.

A unit is a bucket of one-degree tiles and a year. Its rows are sorted along a Z-order curve of their
position and by date, so a file covers a small area and its statistics say which. Regions are
overwritten by what a summary per unit and region knows, without reading other regions' units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch import schemas
from tarnwatch.functions.geo import cell_key
from tarnwatch.sources.buckets import BUCKETS, BucketStore, bucket_of
from tarnwatch.session import stage

#: Degrees a tile is wide and tall.
TILE = 1.0
#: Bits of each coordinate that the curve distinguishes: about 600 m.
CURVE_BITS = 16


def tile(degrees: Column) -> Column:
    """Number of the tile's row or column."""
    return F.floor(degrees / TILE).cast("int")


def tile_bucket(lat_tile: Column, lon_tile: Column, buckets: int) -> Column:
    return bucket_of(lat_tile, lon_tile, buckets=buckets)


def _spread(value: Column) -> Column:
    """The bits of a 16-bit number at even places."""
    out = value
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def curve(lat: Column, lon: Column) -> Column:
    """Place on the Z-order curve; out-of-range coordinates are clamped, null stays null."""
    def scaled(value: Column, low: float, width: float) -> Column:
        top = (1 << CURVE_BITS) - 1
        return F.least(F.greatest(F.floor((value - low) / width * (top + 1)), F.lit(0)), F.lit(top)).cast("long")

    return _spread(scaled(lat, -90.0, 180.0)).bitwiseOR(F.shiftleft(_spread(scaled(lon, -180.0, 360.0)), 1))


def _summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "year", "region_id").agg(
        F.count(F.lit(1)).alias("data_points"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))),
    )


def open_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    """The newest version of the observation store at ``path``; an empty one if there is none yet."""
    schema = T.StructType([*schemas.OBSERVATION.fields, T.StructField("curve", T.LongType())])
    return BucketStore(spark, path, schema, buckets, ("bucket", "year"), ("curve", "date"), _summary)


def placed(observations: DataFrame, buckets: int) -> DataFrame:
    """Observations with ``bucket``, ``year`` and ``curve``; columns they lack are null.

    Rows without a date or position have no place and are an error of the caller: ``clean`` drops them.
    """
    have = set(observations.columns)
    columns = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.OBSERVATION.fields]
    return observations.select(*columns).withColumns({
        "curve": curve(F.col("lat"), F.col("lon")),
        "bucket": tile_bucket(tile(F.col("lat")), tile(F.col("lon")), buckets),
        "year": F.year("date"),
    })


def overwrite_regions(store: BucketStore, observations: DataFrame) -> None:
    """Replace the years of the regions present in ``observations``; everything else stays as it is.

    The summary says in which units these regions lie. Only those units, and the ones the new rows
    fall into, are read and written; files of other units are not touched.
    """
    incoming = stage(placed(observations, store.buckets), "incoming-observations")
    keys = stage(incoming.select("region_id", "year").distinct(), "incoming-regions")
    touched, known = store.names(incoming), store.summaries()
    if known is not None:
        touched |= store.names(known.join(keys, ["region_id", "year"], "left_semi"))
    kept = store.read(touched).join(keys, ["region_id", "year"], "left_anti")
    store.replace(kept.unionByName(incoming), touched)


def observations(
    store: BucketStore, region_ids: list[str] | None = None, start: str | None = None, end: str | None = None,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Stored observations with their ``cell_id``.

    ``box`` is (south, west, north, east). Years and the tiles of a small box prune folders; positions
    and dates skip files and row groups.
    """
    df = store.read()
    if start is not None:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col("date") <= F.lit(end).cast("date")))
    if region_ids is not None:
        df = df.where(F.col("region_id").isin(list(region_ids)))
    if box is not None:
        south, west, north, east = box
        df = df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
        rows, columns = (range(int(low // TILE), int(high // TILE) + 1) for low, high in ((south, north), (west, east)))
        if len(rows) * len(columns) <= store.buckets:  # more tiles than buckets prune nothing
            tiles = [(r, c) for r in rows for c in columns]
            spark = store.spark
            numbers = spark.createDataFrame(tiles, "r int, c int").select(tile_bucket(F.col("r"), F.col("c"), store.buckets)).distinct()
            df = df.where(F.col("bucket").isin([b[0] for b in numbers.collect()]))
    return df.drop("bucket", "year", "curve").withColumn("cell_id", cell_key(F.col("lat"), F.col("lon")))


def stored_regions(store: BucketStore) -> DataFrame:
    """Rows, dates and extent of every stored region, from the summaries alone."""
    known = store.summaries()
    if known is None:
        known = _summary(store.read())
    return known.groupBy("region_id").agg(
        F.sum("data_points").alias("data_points"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.min("min_lat").alias("south"), F.min("min_lon").alias("west"), F.max("max_lat").alias("north"), F.max("max_lon").alias("east"),
    )


def around_events(store: BucketStore, events: DataFrame, delta: float = 0.5, days: int = 60) -> DataFrame:
    """Stored observations within ``delta`` degrees and ``days`` of each event (``name, lat, lon, date``).

    Events are copied to the tiles and months their window touches, which name a unit. The distinct
    units, at most as many as the store has, are broadcast and prune the scan; rows then meet events
    by tile and month, and the window is tested exactly. Returns the observations with ``event``.
    """
    def span(centre: str) -> Column:
        return F.explode(F.sequence(tile(F.col(centre) - delta), tile(F.col(centre) + delta)))

    month = lambda date: F.year(date) * 12 + F.month(date)
    probes = (
        events.select(F.col("name").alias("event"), *(F.col(c).alias(f"event_{c}") for c in ("lat", "lon", "date")))
        .where((F.year("event_date") >= 1) & F.col("event_lat").isNotNull() & F.col("event_lon").isNotNull())
        .withColumn("_row", span("event_lat")).withColumn("_column", span("event_lon"))
        .withColumn("_month", F.explode(F.sequence(month(F.date_sub("event_date", days)), month(F.date_add("event_date", days)))))
    )
    first = F.col("_month") - 1
    needed = probes.select(
        tile_bucket(F.col("_row"), F.col("_column"), store.buckets).alias("bucket"), F.floor(first / 12).cast("int").alias("year")
    ).where(F.col("year") >= 0).distinct()
    scanned = store.read().join(F.broadcast(needed), ["bucket", "year"], "left_semi")
    binned = scanned.withColumns({"_row": tile(F.col("lat")), "_column": tile(F.col("lon")), "_month": month(F.col("date"))})
    inside = (
        F.col("lat").between(F.col("event_lat") - delta, F.col("event_lat") + delta)
        & F.col("lon").between(F.col("event_lon") - delta, F.col("event_lon") + delta)
        & F.col("date").between(F.date_sub("event_date", days), F.date_add("event_date", days))
    )
    found = binned.join(probes, ["_row", "_column", "_month"]).where(inside)
    return found.drop("_row", "_column", "_month", "bucket", "year", "curve").withColumn("cell_id", cell_key(F.col("lat"), F.col("lon")))
