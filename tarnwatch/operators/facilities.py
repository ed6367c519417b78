"""Facilities around event locations: candidates, duplicates, nearest thirty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions import facility
from tarnwatch.functions.geo import SphereGrid, bearing_label, haversine_km
from tarnwatch.operators.nearby import rank_within

LIMIT = 30
# Search rings in km inside the search radius; the innermost one that decides is used.
RINGS_KM = (0.4, 1.6, 6.4)
# Two positions with equal 3-decimal coordinates are less than 160 m apart and distances are
# compared after rounding to 100 m: a ring with enough facilities decides once widened by this.
RING_SLACK_KM = 0.5
BINS_PER_RING = 5.0
SITE = ["site_lat", "site_lon"]


def classify(elements: DataFrame) -> DataFrame:
    """Located, classified facilities: one row per element that matches a search group."""
    tags = F.col("tags")
    return (
        elements.withColumns(
            {
                "lat": F.coalesce(F.col("lat"), F.col("center.lat")),
                "lon": F.coalesce(F.col("lon"), F.col("center.lon")),
                "groups": facility.search_groups(F.col("element_type"), tags),
                "type": facility.facility_type(tags),
            }
        )
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.size("groups") > 0))
        .select(
            "element_id",
            "groups",
            facility.facility_name(tags, F.col("type")).alias("name"),
            "type",
            facility.source_category(F.col("type")).alias("source_category"),
            "lat",
            "lon",
            facility.context_tags(tags).alias("tags"),
        )
    )


def _useful(facilities: DataFrame) -> DataFrame:
    """Positions of the facilities: one row per facility and group, without hopeless copies.

    Only what the search and the ranking need is kept; ``same`` stands for the identity used in
    duplicate removal. Copies at one position are equally far from every event and are taken in
    order of arrival, so in the uncapped groups only the first of each identity can be listed, and
    in the capped groups only the first rows up to the cap. This bounds positions with many copies.
    """
    same = facility.identity(F.col("name"), F.col("type"), F.col("lat"), F.col("lon"))
    rows = facilities.select("element_id", "lat", "lon", same.alias("same"), F.explode("groups").alias("group"))
    # Uncapped groups count distinct facilities, capped ones count elements of any identity.
    capped = F.col("group").isin(list(facility.GROUP_CAPS))
    counted = F.when(~capped, F.col("same")).alias("_counted")
    most = _group_cap(F.lit(1))
    return (
        rows.select("*", counted)
        .withColumn("_copy", rank_within(["lat", "lon", "group", "_counted"], "element_id"))
        .where(F.col("_copy") <= most)
        .withColumn("list", _list_of(F.col("group")))
        .drop("_copy", "_counted")
    )


def _group_cap(otherwise: Column, column: str = "group") -> Column:
    cap = otherwise
    for group, most in facility.GROUP_CAPS.items():
        cap = F.when(F.col(column) == group, most).otherwise(cap)
    return cap


def _rings(radius_km: float, rings: tuple[float, ...]) -> list[tuple[int, float, float]]:
    """Number, width and reach of the rings, the innermost first.

    The last two are the search radius and twice that, for sites without anything inside it.
    """
    inner = [(r, r + RING_SLACK_KM) for r in rings if r + RING_SLACK_KM < radius_km]
    outer = [(radius_km, radius_km), (2 * radius_km, 2 * radius_km)]
    return [(i, float(width), float(reach)) for i, (width, reach) in enumerate(inner + outer)]


def _per_ring(df: DataFrame, rings: list[tuple[int, float, float]]) -> DataFrame:
    """Each row once per ring, with the ring's number, width and reach."""
    numbered = F.array(
        *[F.struct(F.lit(i).alias("ring"), F.lit(w).alias("width"), F.lit(r).alias("reach")) for i, w, r in rings]
    )
    return df.select("*", F.explode(numbered).alias("_ring")).select("*", "_ring.*").drop("_ring")


def _grid() -> SphereGrid:
    return SphereGrid(F.col("width") / BINS_PER_RING)


def _list_of(group: Column) -> Column:
    """Which list a row competes for: 0 for the open groups together, else its capped group."""
    return F.when(group.isin(list(facility.GROUP_CAPS)), group).otherwise(0)


def _inner_rings(sites: DataFrame, useful: DataFrame, rings: list[tuple[int, float, float]]) -> DataFrame:
    """Per site and list, the innermost ring that surely holds enough facilities to fill it.

    Works on counts per bin only. A bin counts if it lies inside the ring as a whole, judged from
    one of its members and the diameter of a bin.
    """
    # The open groups count distinct facilities, the capped ones count elements.
    is_open = F.col("list") == 0
    distinct = useful.groupBy(
        "list", F.when(is_open, F.col("same")).alias("_same"), F.when(~is_open, F.col("element_id")).alias("_element")
    ).agg(F.min(F.struct("lat", "lon")).alias("_at"))
    counts = (
        _per_ring(distinct, rings)
        .groupBy("ring", "list", _grid().bin(F.col("_at.lat"), F.col("_at.lon")).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_member"))
    )
    to_member = haversine_km(
        F.col("site_lat"), F.col("site_lon"), F.col("_member.lat"), F.col("_member.lon")
    )
    diameter = F.col("width") * (2**0.5 / BINS_PER_RING)
    needed = _group_cap(F.lit(LIMIT), "list")
    return (
        _grid().cover(_per_ring(sites, rings), *SITE, F.col("width"), len(rings) * 2 * BINS_PER_RING)
        .join(counts, ["ring", "_bin"])
        .where(to_member + diameter <= F.col("width"))
        .groupBy(*SITE, "ring", "list")
        .agg(F.sum("_n").alias("_n"))
        .where(F.col("_n") >= needed)
        .groupBy(*SITE, "list")
        .agg(F.min("ring").alias("_chosen"))
    )


def _search(sites: DataFrame, useful: DataFrame, radius_km: float, rings: tuple[float, ...]) -> DataFrame:
    """Facilities around each site, as far as they can make its list.

    Each list searches the smallest ring that fills it. Where none does, the search covers twice
    the radius, and what lies beyond the radius is dropped if the site has anything inside.
    """
    ladder = _rings(radius_km, rings)
    lists = F.explode(F.array(*[F.lit(n) for n in (0, *facility.GROUP_CAPS)]))
    wanted = sites.withColumn("list", lists)
    chosen = wanted.join(_inner_rings(sites, useful, ladder[:-1]), [*SITE, "list"], "left")
    outermost = F.lit(len(ladder) - 1)
    searching = _per_ring(chosen, ladder).where(F.col("ring") == F.coalesce("_chosen", outermost))
    probes = _grid().cover(searching.drop("_chosen"), *SITE, F.col("reach"), len(ladder) * 2 * BINS_PER_RING).drop("width")
    binned = _per_ring(useful, ladder).withColumn("_bin", _grid().bin(F.col("lat"), F.col("lon")))
    distance = haversine_km(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon"))
    nearest = F.min("_distance").over(Window.partitionBy(*SITE))
    return (
        probes.join(binned.drop("width", "reach"), ["ring", "list", "_bin"])
        .withColumn("_distance", distance)
        .where(F.col("_distance") <= F.col("reach"))
        .withColumn("_nearest", nearest)
        .where((F.col("_distance") <= radius_km) | (F.col("_nearest") > radius_km))
        .select(*SITE, "element_id", "group", "same", "_distance")
    )


def nearest_facilities(
    events: DataFrame, elements: DataFrame, radius_km: float = 25.0, rings: tuple[float, ...] = RINGS_KM
) -> DataFrame:
    """The up to 30 nearest distinct facilities of every event, ranked.

    Events without any facility within ``radius_km`` look within twice the radius. ``events`` has
    ``event_id, lat, lon``. Events repeat at the same grid points, so the search runs once per
    distinct location and on bare positions; names and tags are joined to the final lists.

    How far a list has to look is decided on counts per grid bin, so crowded surroundings are
    searched within a few hundred metres and no site is paired with everything in its radius.
    """
    classified = classify(elements)
    located = events.select("event_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    sites = located.select(*SITE).distinct()
    found = _search(sites, _useful(classified), radius_km, rings)

    cap = _group_cap(F.lit(None).cast("int"))
    ranked = (
        found.withColumn("_in_group", rank_within([*SITE, "group"], "_distance", "element_id"))
        .where(cap.isNull() | (F.col("_in_group") <= cap))
        .withColumn("_copy", rank_within([*SITE, "same"], "group", "element_id"))
        .where(F.col("_copy") == 1)
        .withColumn("distance_km", F.bround("_distance", 1))
        .withColumn("rank", rank_within(SITE, "distance_km", "group", "element_id"))
        .where(F.col("rank") <= LIMIT)
        .select(*SITE, "element_id", "distance_km", "rank")
    )
    direction = bearing_label(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon"))
    listed = ranked.join(classified.drop("groups"), "element_id").withColumn("direction", direction)
    return located.join(listed, SITE).select(
        "event_id", "rank", "element_id", "name", "type", "source_category",
        F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"),
        "distance_km", "direction", "tags",
    )


def facility_lines(facilities: DataFrame) -> DataFrame:
    """One prompt text per event listing its facilities (at most 30 lines)."""
    shown_tags = F.transform(
        F.filter(F.map_entries("tags"), lambda e: e["key"] != "landuse"),
        lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
    )
    suffix = F.when(F.size(shown_tags) > 0, F.concat(F.lit(" ["), F.array_join(shown_tags, ", "), F.lit("]")))
    line = F.concat(
        F.lit("- "), F.col("name"), F.lit(": "), F.replace("type", F.lit("_"), F.lit(" ")), F.lit(", "),
        F.col("distance_km").cast("string"), F.lit("km "), F.col("direction"),
        F.coalesce(suffix, F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return facilities.groupBy("event_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("facilities_text"),
        F.count(F.lit(1)).cast("int").alias("n_facilities"),
    )
