"""Readers and writers on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import text
from tarnwatch.sources import catalogs, elements, geojson, gridded

CSV = """time,latitude,longitude,chlorophyll
UTC,degrees_north,degrees_east,mg m-3
2024-07-03T00:00:00Z,41.64583,-83.02083,12.4
2024-07-03T00:00:00Z,41.6875,-83.02083,NaN
2024-07-11T00:00:00Z,41.64583,-83.02083,-1.0
2024-07-11T00:00:00Z,41.6875,-83.02083,412.0
bad-date,41.6875,-83.02083,3.0
"""


def test_gridded_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text(CSV.replace("12.4", "13.5"))
    rows = gridded.read_gridded_csv(spark, str(tmp_path)).orderBy("chl_a").collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 7, 3), 41.6458, -83.0208, v) for v in (12.4, 13.5)]


def test_gridded_csv_with_several_headers(spark, tmp_path):
    other = "lon,Lat_deg,chlor_a,time_utc,flag\ndegrees_east,degrees_north,mg m-3,UTC,\n-83.5,41.5,7.5,2024-07-05T00:00:00Z,x\n"
    (tmp_path / "a b+c.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text(other)
    (tmp_path / "c%41.csv").write_text(other.replace("7.5", "8.5").replace("\n", "\r\n"))
    (tmp_path / "empty.csv").write_text("")
    assert sorted(map(len, gridded.header_groups(spark, str(tmp_path)).values())) == [1, 2]
    rows = gridded.read_gridded_csv(spark, str(tmp_path)).orderBy("chl_a")
    assert [tuple(r) for r in rows.select("date", "lat", "lon", "chl_a", "flag").collect()] == [
        (dt.date(2024, 7, 5), 41.5, -83.5, 7.5, "x"), (dt.date(2024, 7, 5), 41.5, -83.5, 8.5, "x"), (dt.date(2024, 7, 3), 41.6458, -83.0208, 12.4, None)]
    (tmp_path / "bad.csv").write_text("time,lat\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        gridded.read_gridded_csv(spark, str(tmp_path))


def test_headers_need_all_columns(spark):
    table = spark.createDataFrame([("x", 1.0)], "time string, latitude double")
    with pytest.raises(ValueError, match="missing columns"):
        gridded.normalize_headers(table)
    named = spark.createDataFrame([("x", 1.0, 1.0, 1.0)], "Time_UTC string, Latitude double, Longitude double, Chlor_A double")
    assert gridded.normalize_headers(named).columns == ["date", "lat", "lon", "chl_a"]


def observations(spark, region, days, value):
    rows = [(region, dt.date(2023, 12, 28) + dt.timedelta(days=d), 41.65, -83.0, value) for d in range(days)]
    table = spark.createDataFrame(rows, "region_id string, date date, lat double, lon double, chl_a double")
    for name in ("turbidity", "sst_delta", "precipitation_7d", "wind_speed", "cloud_fraction"):
        table = table.withColumn(name, F.lit(0.0))
    return table.withColumn("source", F.lit("s"))


def test_store_replaces_regions(spark, tmp_path):
    path = str(tmp_path / "store")
    gridded.write_observations(observations(spark, "a", 10, 1.0).unionByName(observations(spark, "b", 10, 1.0)), path)
    gridded.write_observations(observations(spark, "b", 10, 2.0), path)
    totals = {r["region_id"]: r["s"] for r in gridded.read_observations(spark, path).groupBy("region_id").agg(F.sum("chl_a").alias("s")).collect()}
    assert totals == {"a": 10.0, "b": 20.0}
    part = gridded.read_observations(spark, path, ["a"], "2024-01-01", "2024-01-03")
    assert part.count() == 3
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region_id" in plan or "PartitionFilters: [" in plan and "region_id" in plan.split("PartitionFilters")[1][:200]
    listed = {r["cache_key"]: r for r in gridded.stored_regions(spark, path).collect()}
    assert listed["a"]["data_points"] == 10 and listed["b"]["cached_at"] >= listed["a"]["cached_at"]
    assert listed["a"]["file_size_kb"] > 0


def test_first_available_source_per_region(spark):
    def source(name, regions):
        return spark.createDataFrame([(r, name) for r in regions], "region_id string, source string")

    got = gridded.first_available([source("one", "a"), source("two", "ab"), source("three", "abc")])
    assert {(r["region_id"], r["source"]) for r in got.collect()} == {("a", "one"), ("b", "two"), ("c", "three")}


def test_region_scope_fill(spark):
    rows = [("r", 1, 0, 1.0), ("r", 2, 1, None), ("r", 2, 2, 3.0), ("r", 3, 3, None)]
    table = spark.createDataFrame(rows, "region_id string, cell_id long, ordinal long, turbidity double")
    assert gridded.fill_missing(table, ["turbidity"]).count() == 2
    filled = gridded.fill_missing(table, ["turbidity"], scope="region").orderBy("ordinal").collect()
    assert [r["turbidity"] for r in filled] == [1.0, 1.0, 3.0, 3.0]


def test_catalogs(spark, tmp_path):
    def a(region, dates):
        return {"region_id": region, "features": [{"id": f"a{i}", "properties": {"datetime": f"{d}T10:00:00Z"}} for i, d in enumerate(dates)]}

    many = [f"2024-01-{d:02d}" for d in range(1, 13)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps(a(1, many)))
    (tmp_path / "a" / "2.json").write_text(json.dumps(a(2, ["2021-01-01", "2021-01-04"])))
    products = [{"Id": "b1", "ProductType": "OL_2_WFR___", "ContentDate": {"Start": "2021-01-03T00:00:00.000Z"}},
                {"Id": "b2", "ProductType": "OTHER", "ContentDate": {"Start": "2021-03-03T00:00:00.000Z"}}]
    for region in (1, 2, 3):
        (tmp_path / "b" / f"{region}.json").write_text(json.dumps({"region_id": region, "value": products}))
    cat_a, cat_b = catalogs.read_catalog_a(spark, str(tmp_path / "a")), catalogs.read_catalog_b(spark, str(tmp_path / "b"))
    dates = catalogs.product_dates(cat_a, cat_b)
    counts = {r["region_id"]: r["count"] for r in dates.groupBy("region_id").count().collect()}
    assert counts == {1: 12, 2: 3, 3: 1}
    weeks = {(r["iso_year"], r["iso_week"], str(r["date"])) for r in catalogs.weekly_dates(dates).where("region_id = 2").collect()}
    assert weeks == {(2020, 53, "2021-01-01"), (2021, 1, "2021-01-04")}
    regions = spark.createDataFrame([(1,), (3,), (4,)], "region_id long")
    assert [r[0] for r in catalogs.regions_with_products(regions, cat_a, cat_b).orderBy("region_id").collect()] == [1, 3]
    assert [r[0] for r in catalogs.regions_without_products(regions, cat_a, cat_b).collect()] == [4]
    assert catalogs.newest(cat_a, 5).where("region_id = 1").agg(F.min("product_time")).first()[0] == "2024-01-08T10:00:00Z"


def test_map_elements(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"craft": "brewery", "name:en": "B"}},
        {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"landuse": "farmland"}}]}))
    rows = elements.read_elements(spark, str(tmp_path)).orderBy("element_id").collect()
    assert rows[0]["tags"]["name:en"] == "B" and rows[1]["center"]["lon"] == 4.0


def test_geojson_collections_by_date(spark, tmp_path):
    rows = [("r", 1.0 + i, 2.0, f"e{i}", f"2020-01-0{1 + i % 3}") for i in range(25)]
    table = spark.createDataFrame(rows, "region_id string, lon double, lat double, event_id string, date string")
    for name in geojson.PROPERTIES[:-1]:
        table = table if name == "date" else table.withColumn(name, F.lit("x"))
    pages = geojson.feature_collections(table).collect()
    assert sorted((p["date"], p["n_features"]) for p in pages) == [("2020-01-01", 9), ("2020-01-02", 8), ("2020-01-03", 8)]
    seen = {f["properties"]["event_id"] for p in pages for f in json.loads(p["geojson"])["features"]}
    assert seen == {f"e{i}" for i in range(25)}
    geojson.write_feature_lines(table, str(tmp_path / "lines"))
    line = json.loads(spark.read.text(str(tmp_path / "lines")).first()["value"])
    assert line["geometry"]["type"] == "Point"


def test_place_names(spark):
    from tarnwatch import schemas

    answers = [
        '{"name": "Spencer Gulf", "address": {"state": "South Australia", "country": "Australia"}}',
        '{"address": {"city": "A", "town": "A", "county": "B", "state": "C", "country": "D"}}',
        "{}",
    ]
    table = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    place = text.compose_place_name(F.from_json("a", schemas.PLACE), F.lit("fallback"))
    assert [r[0] for r in table.orderBy("i").select(place).collect()] == ["Spencer Gulf, South Australia, Australia", "A, B, C", "fallback"]


def test_stream_stores_each_file_once(spark, tmp_path):
    from tarnwatch.streaming import ingest

    incoming, store, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    incoming.mkdir()
    header = CSV.split("\n")[0].split(",")
    for name, value in (("a", "12.4"), ("b", "13.5")):
        (incoming / f"{name}.csv").write_text(CSV.replace("12.4", value))
        ingest.store_stream(ingest.gridded_stream(spark, str(incoming), header), store, marks)
    rows = spark.read.parquet(store).orderBy("chl_a").collect()
    assert [r["chl_a"] for r in rows] == [12.4, 13.5]
