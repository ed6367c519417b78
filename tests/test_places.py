"""Facility search, reports and key lookup against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oracle import haversine
from tarnwatch.operators import facilities, modeloutput, nearby, report

ELEMENTS = "element_id long, element_type string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
KINDS = [
    {"man_made": "wastewater_plant"}, {"industrial": "chemical"}, {"industrial": "oil"}, {"landuse": "industrial"},
    {"landuse": "farmland"}, {"craft": "brewery"}, {"building": "industrial"},
]


def kind_of(t):
    if t.get("man_made") == "wastewater_plant":
        return "wastewater_plant"
    if t.get("industrial") == "chemical":
        return "chemical_plant"
    if t.get("landuse") == "farmland":
        return "farmland"
    if t.get("landuse") == "industrial":
        return "industrial_zone"
    if t.get("craft"):
        return "craft_brewery"
    if t.get("building") == "industrial":
        return "industrial_building"
    return "industrial_oil"


def groups_of(kind, t):
    way, found = kind == "way", []
    if t.get("man_made") or t.get("industrial") == "chemical":
        found.append(1)
    named = "name" in t and ("industrial" in t or (way and t.get("landuse") == "industrial") or "building" in t)
    if named or "craft" in t:
        found.append(2)
    if way and t.get("landuse") == "industrial":
        found.append(3)
    if way and t.get("landuse") == "farmland":
        found.append(4)
    return found


def by_hand(event, elements, radius=25.0):
    lat, lon = event
    near = [(haversine(lat, lon, e[2], e[3]), g, e) for e in elements for g in groups_of(e[1], e[5])]
    inside = [n for n in near if n[0] <= radius] or [n for n in near if n[0] <= 2 * radius]
    kept = []
    for group in (1, 2, 3, 4):
        members = sorted((n for n in inside if n[1] == group), key=lambda n: (n[0], n[2][0]))
        kept += members[: {3: 20, 4: 10}.get(group)]
    kept.sort(key=lambda n: (n[1], n[2][0]))
    seen, unique = set(), []
    for d, g, e in kept:
        t = e[5]
        name = t.get("name") or kind_of(t).replace("_", " ").title()
        key = (name, kind_of(t), math.floor(e[2] * 1000 + 0.5), math.floor(e[3] * 1000 + 0.5))
        if key not in seen:
            seen.add(key)
            unique.append((round(d, 1), g, e[0]))
    unique.sort()
    return [u[2] for u in unique[:30]]


def make(rng, count, spot, spread, names, start=0):
    rows = []
    for i in range(start, start + count):
        t = dict(rng.choice(KINDS))
        if rng.random() < 0.7:
            t["name"] = rng.choice(names)
        rows.append((i, rng.choice(["node", "way"]), round(spot[0] + rng.uniform(-spread, spread), 4),
                     round(spot[1] + rng.uniform(-spread, spread), 4), None, t))
    return rows


def test_nearest_facilities_against_brute_force(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(12)]
    elements = make(rng, 300, (45.0, 7.0), 0.5, names)
    # A crowded town, and many copies at one position.
    elements += make(rng, 400, (45.1, 7.1), 0.004, [f"t{i}" for i in range(200)], 300)
    elements += [(1000 + i, "way", 45.2, 7.2, None, {"landuse": "farmland"}) for i in range(60)]
    elements += [(2000 + i, "node", 45.25, 7.25, None, {"industrial": "oil", "name": f"c{i % 3}"}) for i in range(60)]
    events = {i: (round(45 + rng.uniform(-0.6, 0.6), 4), round(7 + rng.uniform(-0.6, 0.6), 4)) for i in range(40)}
    events |= {100: (45.1, 7.1), 101: (45.2, 7.2), 102: (45.9, 7.0), 103: (60.0, 7.0), 104: (45.1, 7.1), 105: (45.105, 7.095)}
    got = {}
    rows = facilities.nearest_facilities(
        spark.createDataFrame([(k, *v) for k, v in events.items()], "event_id long, lat double, lon double"),
        spark.createDataFrame(elements, ELEMENTS),
    )
    for r in rows.orderBy("event_id", "rank").collect():
        got.setdefault(r["event_id"], []).append(r["element_id"])
    want = {k: by_hand(v, elements) for k, v in events.items()}
    assert got == {k: v for k, v in want.items() if v}
    assert 103 not in got and len(got[100]) == 30


def test_center_coordinates_and_lines(spark):
    elements = [
        (1, "way", None, None, (10.0, 10.01), {"industrial": "chemical", "name": "Works", "landuse": "industrial", "operator": "Co"}),
        (2, "node", None, None, None, {"industrial": "chemical", "name": "Nowhere"}),
        (3, "way", None, None, (10.0, 10.02), {"landuse": "farmland"}),
    ]
    rows = facilities.nearest_facilities(
        spark.createDataFrame([(1, 10.0, 10.0)], "event_id long, lat double, lon double"), spark.createDataFrame(elements, ELEMENTS)
    )
    text = facilities.facility_lines(rows).first()
    assert text["facilities_text"] == '- Works: chemical plant, 1.1km E [operator="Co", industrial="chemical"]\n- Farmland: farmland, 2.2km E'
    assert text["n_facilities"] == 2


FACILITY = "event_id long, rank int, name string, lat double, lon double, distance_km double"
SOURCE = "event_id long, source_rank int, source_name string, distance_km double, coordinates array<double>"


def test_source_coordinates(spark):
    listed = spark.createDataFrame([
        (1, 1, "Acme Plant", 1.0, 1.0, 3.0), (1, 2, "Plant", 2.0, 2.0, 4.0), (1, 3, "acme plant", 9.0, 9.0, 9.9), (1, 4, "", 5.0, 5.0, 1.0),
    ], FACILITY)
    told = spark.createDataFrame([
        (1, 1, "ACME PLANT", 0.0, None), (1, 2, "The Plant of Acme", None, None), (1, 3, "", None, None),
        (1, 4, "Plant", 7.0, [0.5, 0.5]), (1, 5, "plan", 8.0, None), (2, 1, "Plant", None, None),
    ], SOURCE)
    got = {(r["event_id"], r["source_rank"]): (r["coordinates"], r["distance_km"])
           for r in report.match_source_coordinates(told, listed).collect()}
    assert got == {
        (1, 1): ([9.0, 9.0], 9.9), (1, 2): ([2.0, 2.0], 4.0), (1, 3): (None, None), (1, 4): ([0.5, 0.5], 7.0),
        (1, 5): ([9.0, 9.0], 8.0), (2, 1): (None, None),
    }


@pytest.mark.parametrize("raw, level, parsed", [
    ('```json\n{"alert_level": "SEVERE", "probable_sources": [{"source_name": "A", "coordinates": [1, 2]}]}\n```', "SEVERE", True),
    ('Sure! {"alert_level": "CRITICAL"} Anything else?', "CRITICAL", True),
    ("no braces here", "MODERATE", False),
    ('{"alert_level": ', "MODERATE", False),
    ('{"alert_level": "LOW", "x": {"a": 1, "a": 2}, "alert_level": "SEVERE"}', "SEVERE", True),
    ('Here: ```json {"alert_level": "LOW", "alert_level": "HIGH"}``` done', "HIGH", True),
    ('{"alert_level": "LOW", "alert_level": "HIGH"} and {b}', "MODERATE", False),
    ("{'alert_level': 'LOW'}", "MODERATE", False),
    ('{"alert_level": "LOW", "alert_level": "HIGH",}', "MODERATE", False),
    ("", "MODERATE", False), (None, "MODERATE", False), ("[1, 2]", "MODERATE", False),
])
def test_model_output(spark, raw, level, parsed):
    row = modeloutput.parse_reports(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row["report"]["alert_level"], row["parsed"]) == (level, parsed)
    if not parsed:
        assert row["report"]["probable_sources"] == [] and row["report"]["drinking_water_impact"]["who_threshold_exceeded"] is False


def test_nearby_keys(spark):
    keys = spark.createDataFrame([("41.65_-83.00", 41.65, -83.0), ("41.60_-83.00", 41.6, -83.0), ("50.00_0.00", 50.0, 0.0)],
                                 "cache_key string, lat double, lon double")
    wanted = [(1, 41.62, -83.0, "41.62_-83.00"), (2, 41.6, -83.0, "41.60_-83.00"), (3, 45.0, 0.0, "45.00_0.00")]
    requests = spark.createDataFrame(wanted, "request_id int, request_lat double, request_lon double, request_key string")
    got = {r["request_id"]: (r["cache_key"], r["exact"]) for r in nearby.nearby_keys(requests, keys).collect()}
    assert got == {1: ("41.60_-83.00", False), 2: ("41.60_-83.00", True)}


def test_nearby_keys_of_crowded_bins_travel_as_lists(spark, monkeypatch):
    monkeypatch.setattr(nearby, "KEYS_PER_LIST", 7)
    rng = random.Random(2)
    at = lambda: (round(rng.uniform(10, 10.5), 2), round(rng.uniform(-0.3, 0.3), 2))
    stored = {(f"{lat:.2f}_{lon:.2f}", lat, lon) for lat, lon in (at() for _ in range(400))}
    wanted = [(rng.choice([None, *range(90)]), *at()) for _ in range(150)]
    wanted = [(i, lat, lon, rng.choice([None, f"{lat:.2f}_{lon:.2f}"])) for i, lat, lon in wanted]
    expected = {}
    for i, lat, lon, key in wanted:
        near = [(k != key, (a - lat) * (a - lat) + (b - lon) * (b - lon), k) for k, a, b in stored if abs(a - lat) <= 0.1 and abs(b - lon) <= 0.1]
        expected[i] = min([*near, *([expected[i]] if i in expected else [])], default=None)
    keys = spark.createDataFrame(sorted(stored) * 2, "cache_key string, lat double, lon double")
    requests = spark.createDataFrame(wanted, "request_id int, request_lat double, request_lon double, request_key string")
    found = nearby.nearby_keys(requests, keys).collect()
    assert {r["request_id"]: (not r["exact"], r["cache_key"]) for r in found} == {i: (hit[0], hit[2]) for i, hit in expected.items() if hit}
    assert len(found) == len({r["request_id"] for r in found})


EVENT = "event_id long, region_id string, date date, lat double, lon double, severity string, confidence double, chl_a_value double, chl_a_baseline double, z_score double, weather_context string"


def test_reports_nest_and_render(spark, tmp_path):
    import datetime as dt

    events = spark.createDataFrame([
        (1, "41.65_-83.00", dt.date(2014, 8, 2), 41.65, -83.0, "critical", 1.0, 25.25, 0.5, 4.5, "calm_conditions"),
        (2, "41.65_-83.00", dt.date(2014, 8, 2), 41.65, -83.0, "moderate", 0.7, 9.0, 3.0, 2.5, "other"),
    ], EVENT)
    elements = spark.createDataFrame([(1, "node", 41.66, -83.0, None, {"man_made": "wastewater_plant", "name": "Plant"})], ELEMENTS)
    near = facilities.nearest_facilities(events.where("event_id = 1"), elements)
    rows = {r["event_id"]: r for r in report.community_reports(events, near).collect()}
    assert rows[1]["probable_sources"][0]["evidence"] == (
        "Plant is a wastewater plant facility located 1.1km N of the anomaly. Direct discharge pathway likely.")
    assert rows[1]["probable_sources"][0]["likelihood"] == "high"
    assert "This represents a 25.2x deviation from the rolling baseline of 0.5 mg/m³ (z-score: 4.5). Immediate" in rows[1]["alert_summary"]
    assert rows[1]["metadata"]["sources_consulted"] == "4"
    assert [a["priority"] for a in rows[1]["recommended_actions"]] == ["immediate", "immediate", "within_24h", "within_week"]
    assert rows[2]["probable_sources"][0]["source_name"] == "Seasonal algal productivity"
    assert "under monitored conditions" in rows[2]["alert_summary"]
    assert rows[2]["report_key"] == "41.65_-83.00_2014-08-02_41.65_-83.0"
    text = {r["event_id"]: r["report_text"] for r in report.render_text(report.community_reports(events, near), events).collect()}
    assert "Coordinates: 41.6500°N, 83.0000°W" in text[1]
    assert "[WITHIN 24H] Coordinate with upstream agencies" in text[1]
    assert "   Distance: unknown\n" in text[2]
    report.write_reports(report.community_reports(events, near), str(tmp_path / "reports"))
    near_zero = events.where("event_id = 2").withColumn("lat", F.lit(0.0005)).withColumn("lon", F.lit(-5e-05))
    odd = report.community_reports(near_zero, near.where("false")).first()
    assert odd["report_key"].endswith("_0.0005_-5e-05") and odd["metadata"]["event_coordinates"] == "[0.0005, -5e-05]"
    told = report.community_reports(events, near).withColumn("probable_sources", F.transform("probable_sources", lambda s: s.withField("distance_km", F.lit(15.0))))
    assert all("   Distance: 15 km\n" in r["report_text"] for r in report.render_text(told, events).collect())
    back = spark.read.json(str(tmp_path / "reports"))
    assert back.select(F.sum(F.size("recommended_actions"))).first()[0] == 6
