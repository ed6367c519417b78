"""Golden values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oracle import haversine
from tarnwatch.functions import climatology, facility, geo, text, votes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, km, direction", [
    ((41.65, -83.0), (41.5, -82.8), 23.5579, "SE"),
    ((0.0, 0.0), (1.0, 0.0), 111.1949, "N"),
    ((0.0, 0.0), (0.0, -1.0), 111.1949, "W"),
    ((-34.5, 137.0), (-33.03, 137.58), 172.0238, "N"),
])
def test_distance_and_bearing(spark, a, b, km, direction):
    points = [F.lit(v) for v in (*a, *b)]
    assert one(spark, geo.haversine_km(*points)) == pytest.approx(km, abs=1e-4)
    assert one(spark, geo.bearing_label(*points)) == direction


def test_distance_of_antipodes(spark):
    assert one(spark, geo.haversine_km(*map(F.lit, (90.0, 0.0, -90.0, 0.0)))) == pytest.approx(20015.087, abs=1e-3)


@pytest.mark.parametrize("lat, day, value", [
    (41.65, 120, 6.000001), (-34.5, 120, 4.611446), (0.0, 280, 8.480403), (70.0, 1, 1.506284),
])
def test_seasonal_expectation(spark, lat, day, value):
    assert one(spark, climatology.expected_chl(F.lit(lat), F.lit(day))) == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("value, digits", [
    (1.005, 2), (1.015, 2), (30.105, 2), (30.245, 2), (0.125, 2), (0.375, 2), (2.5, 0), (3.5, 0), (-1.005, 2),
    (-0.125, 2), (87.55, 1), (0.25, 1), (0.75, 1), (99.995, 2), (0.0, 2), (123456.785, 2), (-79.895, 2),
])
def test_fixed_formats_like_printf(spark, value, digits):
    assert one(spark, text.fixed(F.lit(value), digits)) == f"{value:.{digits}f}"


def test_fixed_on_many_values(spark):
    values = [i / 1000 for i in range(-5000, 5000)] + [i / 1024 for i in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = [r[0] for r in rows.select(text.fixed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_keys_and_labels(spark):
    lat, lon = F.lit(41.65), F.lit(-83.0)
    assert one(spark, geo.location_key(lat, lon)) == "41.65_-83.00"
    assert one(spark, geo.location_label(lat, lon)) == "41.65N, 83.00W"
    region = one(spark, geo.region_struct(lat, lon, F.lit(""), F.lit(None).cast("string")))
    assert region["name"] == "Water body at 41.65, -83.00"
    assert region["country"] == "Unknown"
    assert region["bbox"] == [-83.5, 41.15, -82.5, 42.15]
    assert region["highlight_event"] is None


@pytest.mark.parametrize("z, iso, spatial, doubles, percent", [
    (0, 0, 0, False, False), (1, 0, 0, False, False), (0, 1, 0, False, False),
    (1, 0, 1, False, True), (1, 1, 0, True, True), (1, 1, 1, True, True),
])
def test_vote_table(spark, z, iso, spatial, doubles, percent):
    flags = [F.lit(float(v)) for v in (z, iso, spatial)]
    assert one(spark, votes.is_anomaly(*flags)) is doubles
    assert one(spark, votes.is_anomaly(*flags, exact=True)) is percent


def test_missing_std_stays_missing(spark):
    nothing = F.lit(None).cast("double")
    assert one(spark, votes.zscore(F.lit(5.0), F.lit(3.0), nothing)) is None
    assert one(spark, votes.zscore(F.lit(5.0), F.lit(3.0), F.lit(0.2))) == 2.0


def test_severity_steps(spark):
    yes, no = F.lit(True), F.lit(False)
    assert [one(spark, votes.severity(F.lit(z), yes)) for z in (4.1, -4.0, 3.0, 2.5)] == [
        "critical", "severe", "moderate", "moderate"]
    assert one(spark, votes.severity(F.lit(9.0), no)) == "none"


def test_event_id(spark):
    got = one(spark, votes.event_id(F.lit("41.65_-83.00"), F.lit(dt.date(2024, 7, 3)), F.lit(41.64583), F.lit(-83.0)))
    assert got == "41.65_-83.00_2024-07-03_41.6458_-83.0"


@pytest.mark.parametrize("typed, expected", [
    ("47.5, -87.5", (47.5, -87.5)), ("47.5 -87.5", (47.5, -87.5)), ("47.5°S 87.5°W", (47.5, 87.5)),
    ("-95.5, 12", (12.0, -95.5)), ("Lake Erie", None), ("91 181", None), ("1,2,3", None),
])
def test_parse_coordinates(spark, typed, expected):
    got = one(spark, text.parse_coordinates(F.lit(typed)))
    assert (None if got is None else tuple(got)) == expected


def test_place_parts_and_water(spark):
    name = F.lit("Lake Erie, Ohio, USA")
    assert one(spark, text.place_title(name)) == "Lake Erie"
    assert one(spark, text.place_context(name)) == "Ohio, USA"
    assert one(spark, text.place_context(F.lit("Toledo"))) == ""
    assert one(spark, text.is_water_name(F.lit("Newport News"))) is True
    assert one(spark, text.is_water_name(F.lit("Toledo"))) is False


def test_region_ties_go_to_the_first(spark):
    assert one(spark, text.infer_region(F.lit("Toledo and Kisumu"))) == "lake_erie"
    assert one(spark, text.infer_region(F.lit("Kisumu, Mwanza, Toledo"))) == "lake_victoria"
    assert one(spark, text.infer_region(F.lit("nowhere"))) == "global"


def test_chunk_id(spark):
    assert one(spark, text.chunk_id(F.lit("epa.permits.md"), F.lit(7))) == "epa_permits_md_0007"


def tags(**pairs):
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


@pytest.mark.parametrize("pairs, kind", [
    ({"man_made": "wastewater_plant", "industrial": "chemical"}, "wastewater_plant"),
    ({"amenity": "waste_disposal", "man_made": "works"}, "waste_disposal"),
    ({"industrial": "chemical", "man_made": "works"}, "chemical_plant"),
    ({"landuse": "industrial", "craft": "brewery"}, "industrial_zone"),
    ({"craft": "brewery"}, "craft_brewery"),
    ({"building": "industrial", "industrial": "oil"}, "industrial_building"),
    ({"industrial": "oil"}, "industrial_oil"),
    ({"shop": "x"}, "industrial"),
])
def test_facility_types(spark, pairs, kind):
    assert one(spark, facility.facility_type(tags(**pairs))) == kind


def test_facility_names_and_context(spark):
    given = tags(**{"name": "", "operator": "City", "landuse": "industrial", "website": ""})
    assert one(spark, facility.facility_name(given, F.lit("industrial_zone"))) == "City"
    assert one(spark, facility.facility_name(tags(shop="x"), F.lit("industrial_zone"))) == "Industrial Zone"
    assert one(spark, facility.context_tags(given)) == {"operator": "City", "landuse": "industrial"}


@pytest.mark.parametrize("element, pairs, groups", [
    ("node", {"industrial": "chemical", "name": "A"}, [1, 2]),
    ("node", {"landuse": "industrial", "name": "A"}, []),
    ("way", {"landuse": "industrial", "name": "A"}, [2, 3]),
    ("way", {"landuse": "farmland"}, [4]),
    ("node", {"craft": "brewery"}, [2]),
    ("relation", {"man_made": "works"}, []),
])
def test_search_groups(spark, element, pairs, groups):
    assert one(spark, facility.search_groups(F.lit(element), tags(**pairs))) == groups


def test_grid_cover_holds_every_point_in_reach(spark):
    """Bins of all points within the radius are covered, also at the poles and the date line."""
    import random

    rng = random.Random(5)
    centres = [(0.0, 179.99), (0.0, -180.0), (89.97, 10.0), (-89.99, -170.0), (65.0, 179.9), (45.0, 0.0), (90.0, 0.0)]
    pairs = []
    for i, (lat, lon) in enumerate(centres):
        for _ in range(300):
            plat = max(-90.0, min(90.0, lat + rng.uniform(-0.3, 0.3)))
            spread = 180.0 if abs(lat) > 89 else 0.6
            plon = (lon + rng.uniform(-spread, spread) + 180.0) % 360.0 - 180.0
            if haversine(lat, lon, plat, plon) <= 20.0:
                pairs.append((i, lat, lon, plat, plon))
    assert len(pairs) > 300
    points = spark.createDataFrame(pairs, "i int, lat double, lon double, plat double, plon double")
    for size in (3.0, 20.0, 55.0):
        grid = geo.SphereGrid(size)
        covers = grid.cover(points.select("i", "lat", "lon").distinct(), "lat", "lon", 20.0, 40.0 / size)
        assert covers.count() == covers.distinct().count()
        binned = points.select("i", "plat", "plon", grid.bin(F.col("plat"), F.col("plon")).alias("_bin"))
        assert binned.join(covers, ["i", "_bin"], "left_anti").count() == 0


def test_points_of_a_bin_are_close(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(20000)]
    rows += [(60 + rng.uniform(0, 0.2), 20 + rng.uniform(0, 0.4)) for _ in range(2000)]
    size = 7.0
    grid = geo.SphereGrid(size)
    points = spark.createDataFrame(rows, "lat double, lon double")
    points = points.withColumn("bin", grid.bin(F.col("lat"), F.col("lon")))
    other = points.select("bin", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    far = points.join(other, "bin").agg(F.max(geo.haversine_km(*map(F.col, ("lat", "lon", "lat2", "lon2"))))).first()[0]
    assert far <= size * 2**0.5


def test_number_text_is_the_shortest_decimal(spark):
    from tarnwatch.functions.geo import number_text, snap

    values = [0.0005, 0.0001, 0.00005, 0.000012, 1e-10, 12.5, -0.0005, 0.0, 41.6, -120.25]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [repr(r["v"]) for r in rows]
    assert spark.createDataFrame([(41.60625,), (41.60635,)], "v double").select(snap(F.col("v"))).collect() == [(41.6062,), (41.6064,)]
