"""Large JSON arrays and product footprints against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import footprints
from tarnwatch.sources import catalogs, elements, jsonarrays

ODD = ["plain", "a}b{c", 'q"uote', "back\\slash", "end\\", "nl\nnl", "[x]{y}", "é漢}", ""]
OUTER = "region_id long, note string, osm struct<a:string>"
ELEMENT = "id long, name string, geo string, tags map<string,string>"


def items(rng, start, count):
    return [{"id": start + i, "name": rng.choice(ODD) + str(i), "geo": {"t": "P", "c": [[i, {"z": [1, {"y": "}"}]}]]}, "tags": {"k": rng.choice(ODD)}} for i in range(count)]


@pytest.fixture(scope="module")
def responses(tmp_path_factory):
    rng, folder, expected, start = random.Random(3), tmp_path_factory.mktemp("json"), [], 0
    for file, sizes in enumerate([[2000], [40, 1, 0], [0], []]):
        out = []
        for n, size in enumerate(sizes):
            own, start = items(rng, start, size), start + size
            response = {"osm": {"a": {"b": [{"id": -1}]}}, "region_id": file * 10 + n, "note": "x}{]", "links": [{"id": -5, "name": "no"}, 7],
                        "features": own, "after": [{"id": -6}], "tail": '"features":['}
            out.append(json.dumps(response, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
            expected += [(file * 10 + n, e["id"], e["name"], json.dumps(e["geo"]), e["tags"]["k"]) for e in own]
        (folder / f"{file}.json").write_text("\n".join(out) + rng.choice(["", "\n"]))
    (folder / "z.json").write_text('{"region_id": 99, "features": null}')
    return str(folder), sorted(expected)


def rows(frame):
    return sorted((r["region_id"], r["element"]["id"], r["element"]["name"], json.dumps(json.loads(r["element"]["geo"])), r["element"]["tags"]["k"]) for r in frame.collect())


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 3000, 40])
def test_arrays_equal_the_whole_parse(spark, responses, chunk_bytes):
    path, expected = responses
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        frame = jsonarrays.read_array(spark, path, "features", ELEMENT, OUTER, chunk_bytes)
        assert rows(frame) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["note"] for r in frame.select("note").distinct().collect()} == {"x}{]"}


def test_one_large_response_is_read_by_many_tasks(spark, tmp_path):
    count = 30_000
    text = ",".join(json.dumps({"type": "node", "id": i, "lat": i / 7, "lon": 2.0, "tags": {"name": "n}" * (i % 5)}}) for i in range(count))
    (tmp_path / "one.json").write_text('{"version": 0.6, "elements": [' + text + "]}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        blocks = spark.read.option("lineSep", "}").text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
        split = elements.read_elements(spark, str(tmp_path))
        assert blocks > 5
        key = ["element_id", "lat", F.col("tags")["name"].alias("name")]
        whole = elements.read_elements(spark, str(tmp_path), split=False)
        assert split.count() == count and split.select(key).exceptAll(whole.select(key)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_escapes_are_told_from_quotes():
    import numpy as np

    for text in ('"a\\"b"', '"\\\\"', '"\\\\\\""', "\\\\", '"', ""):
        seen, escaped = [], False
        for c in text:
            seen.append(c == '"' and not escaped)
            escaped = c == "\\" and not escaped
        assert jsonarrays._quotes(np.frombuffer(text.encode(), np.uint8)).tolist() == seen


def test_well_known_text_reads_as_geojson(spark):
    texts = [
        ("geography'SRID=4326;POLYGON ((1 2, 3.5 -4e1, 5 6, 1 2))'", [[[[1.0, 2.0], [3.5, -40.0], [5.0, 6.0], [1.0, 2.0]]]]),
        ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5 9,6 5 9,6 6 9,5 5 9),(5.1 5.1,5.2 5.1,5.2 5.2,5.1 5.1)))", 2),
        ("POINT(1 2)", None), (None, None), ("", None), ("POLYGON EMPTY", None),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    found = [r[0] for r in frame.orderBy("i").select(footprints.polygons_of(footprints.geometry_of_text(F.col("t")))).collect()]
    assert found[0] == texts[0][1] and len(found[1]) == 2 and len(found[1][1]) == 2 and found[1][1][0][0][:2] == [5.0, 5.0]
    assert found[2:] == [None] * 4


def clipped(points, west, south, east, north):
    """Sutherland-Hodgman: what of a convex polygon lies in the box."""
    for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out = []
        for a, b in zip(points, points[1:] + points[:1]):
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        points = out
    return bool(points)


def test_convex_footprints_meet_boxes_as_clipping_says(spark):
    rng = random.Random(9)
    shapes = []
    for i in range(300):
        x, y, size = rng.uniform(-180, 180), rng.uniform(-60, 60), rng.choice([0.3, 2.0, 9.0, 25.0])
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 8)))
        shapes.append([(x + size * math.cos(a), y + size * math.sin(a) * 0.8) for a in angles])
    wrap = lambda lon: (lon + 180) % 360 - 180
    products = spark.createDataFrame([(i, f"t{i}", [[[[wrap(a), b] for a, b in s]]]) for i, s in enumerate(shapes)], "product_id int, product_time string, footprint array<array<array<array<double>>>>")
    boxes = [(j, rng.uniform(-80, 80), rng.choice([rng.uniform(-180, 180), 179.8, -179.9, 180.0, -180.0])) for j in range(120)]
    regions = spark.createDataFrame([*boxes, (900, None, 1.0)], "region_id int, lat double, lon double")
    found = {(r["product_id"], r["region_id"]) for r in footprints.meeting_boxes(products, regions).collect()}
    expected = {(i, j) for i, s in enumerate(shapes) for j, lat, lon in boxes
                if any(clipped([(a + turn, b) for a, b in s], lon - 0.5, lat - 0.5, lon + 0.5, lat + 0.5) for turn in (-720, -360, 0, 360, 720))}
    assert found == expected and len(found) > 100


def _corners(x, y, r):
    return [[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r]]


def test_holes_poles_parts_and_odd_footprints(spark):
    square = lambda x, y, r: [[float(a), float(b)] for a, b in _corners(x, y, r)]
    cap = [[lon, 70.0] for lon in (-180.0, -90.0, 0.0, 90.0)]
    shapes = {
        "hole": [[square(10, 10, 5), square(10, 10, 2)]],
        "two": [[square(50, 0, 1)], [square(70, 0, 1)]],
        "cap": [[cap]],
        "closed": [[square(-30.0, -30.0, 1) + [[-31.0, -31.0]]]],
        "line": [[[[0.0, 50.0], [1.0, 50.0]]]], "none": None, "empty": [], "nothing": [[]], "nulls": [[[[0.0, None], [None, None], [1.0, 1.0]]]],
    }
    products = spark.createDataFrame([(k, "t", s) for k, s in shapes.items()] * 2, "product_id string, product_time string, footprint array<array<array<array<double>>>>")
    regions = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 12.2), (3, 0.0, 50.0), (4, 0.0, 60.0), (5, 0.0, 71.4), (6, 85.0, 123.0), (7, 89.9, -5.0), (8, 60.0, 0.0), (9, -30.0, -30.0), (10, 50.0, 0.5), (11, 1.0, 1.0)], "region_id int, lat double, lon double")
    found = sorted(tuple(r) for r in footprints.meeting_boxes(products, regions).select("product_id", "region_id").collect())
    assert found == [("cap", 6), ("cap", 7), ("closed", 9), ("hole", 2), ("two", 3), ("two", 5)]


def test_pairs_are_not_shuffled_and_repeated_ids_meet_once(spark, monkeypatch):
    square = lambda x, y: [[[float(a), float(b)] for a, b in _corners(x, y, 3)]]
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), f"t{rng.randrange(9)}" if n % 7 else None, [square(rng.uniform(-180, 177), rng.uniform(-20, 20)) for _ in range(n % 3 + 1)]) for n in range(80)]
    boxes = [(rng.choice([None, *range(15)]), rng.uniform(-20, 20), rng.uniform(-180, 180)) for _ in range(60)]
    products = spark.createDataFrame(rows, "product_id int, product_time string, footprint array<array<array<array<double>>>>")
    regions = spark.createDataFrame(boxes, "region_id int, lat double, lon double")
    expected = {}
    for i, t, shape in rows:
        for j, lat, lon in boxes:
            if any(abs((x + 3) - lon + turn) <= 3.5 and abs((y + 3) - lat) <= 3.5 for (((x, y), *_),) in shape for turn in (-360, 0, 360)):
                expected.setdefault((j, i), set()).add(t)
    first = {k: None if None in v else min(v) for k, v in expected.items()}
    for most in (200, 4):
        monkeypatch.setattr(footprints, "MOST_PARTS", most, raising=False)
        found = [((r["region_id"], r["product_id"]), r["product_time"]) for r in footprints.meeting_boxes(products, regions).collect()]
        assert len(found) == len(first) and dict(found) == first
    single = products.withColumn("product_id", F.monotonically_increasing_id())
    plan = footprints.meeting_boxes(single, regions.where("region_id IS NULL").limit(1).union(regions.dropDuplicates(["region_id"]).where("region_id IS NOT NULL")))
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("Exchange" in line for line in lines[:next(i for i, line in enumerate(lines) if "Join" in line)])


def test_pairs_are_tested_as_arrays_if_boxes_fit_in_memory(spark, monkeypatch):
    rng = random.Random(31)
    ring = lambda x, y, r, k: [[x + r * math.cos(2 * math.pi * i / k), y + r * math.sin(2 * math.pi * i / k)] for i in range(k)]
    wrap = lambda points: [[(a + 180) % 360 - 180, b] for a, b in points]
    rows = []
    for n in range(120):
        x, y, r = rng.uniform(-180, 180), rng.uniform(-70, 70), rng.choice([0.4, 3.0, 12.0])
        shape = [[wrap(ring(x, y, r, 7)), wrap(ring(x, y, r / 2, 5))], [wrap(ring(x + 20, y, r, 4))]]
        rows.append((rng.choice([None, *range(90)]), rng.choice([None, "a", "b"]), shape))
    boxes = [(rng.choice([None, *range(150)]), rng.uniform(-80, 80), rng.choice([rng.uniform(-180, 180), 179.9, -179.9])) for _ in range(200)]
    products = spark.createDataFrame(rows, "product_id int, product_time string, footprint array<array<array<array<double>>>>")
    regions = spark.createDataFrame(boxes, "region_id int, lat double, lon double")
    found = []
    for side in (footprints.small_side, lambda stored: stored):
        monkeypatch.setattr(footprints, "small_side", side)
        met = footprints.meeting_boxes(products, regions)
        found.append(sorted(map(str, met.collect())))
        plans = met._jdf.queryExecution().executedPlan().toString()
        assert ("exists(" in plans) == (len(found) == 2)  # pairs are not tested one by one
    assert found[0] == found[1] and len(found[0]) > 60
    monkeypatch.undo()
    empty = footprints.meeting_boxes(products, regions.where("lat > 100"))
    assert empty.count() == 0 and empty.columns == ["region_id", "product_id", "product_time"]


def test_catalogs_keep_the_products_of_a_box(spark, tmp_path):
    feature = lambda i, x: {"id": f"a{i}", "properties": {"datetime": f"2024-01-0{i}T00:00:00Z"}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 3, 0], [x + 3, 3], [x, 3], [x, 0]]]}}
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps({"features": [feature(1, 0), feature(2, 40), feature(1, 0), {"id": "bare", "properties": {"datetime": "2024-01-09T00:00:00Z"}}]}))
    product = lambda i, kind, text: {"Id": f"b{i}", "ProductType": kind, "ContentDate": {"Start": f"2024-02-0{i}T00:00:00.000Z"}, "Footprint": text}
    inside, outside = "geography'SRID=4326;POLYGON((0 0, 3 0, 3 3, 0 3, 0 0))'", "geography'SRID=4326;POLYGON((100 0, 103 0, 103 3, 100 3, 100 0))'"
    (tmp_path / "b" / "1.json").write_text(json.dumps({"value": [product(1, "OL_2_WFR___", inside), product(2, "OTHER", inside), product(3, "OL_2_WFR___", outside)]}))
    regions = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 41.0), (3, -50.0, 1.0)], "region_id long, lat double, lon double")
    for split in (True, False):
        a = catalogs.products_in_boxes(catalogs.read_catalog_a(spark, str(tmp_path / "a"), split), regions)
        b = catalogs.products_in_boxes(catalogs.read_catalog_b(spark, str(tmp_path / "b"), split), regions)
        assert sorted(map(tuple, a.collect())) == [(1, "a1", "2024-01-01T00:00:00Z"), (2, "a2", "2024-01-02T00:00:00Z")]
        assert sorted(map(tuple, b.collect())) == [(1, "b1", "2024-02-01T00:00:00.000Z")]
        dates = {(r["region_id"], str(r["date"])) for r in catalogs.product_dates(a, b).collect()}
        assert dates == {(1, "2024-01-01"), (1, "2024-02-01"), (2, "2024-01-02")}
