"""The bucketed stores: what a change touches, what readers see, what a scan reads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import validate
from tarnwatch.sources import buckets, documents, obstore


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "collection string, chunk_id string, chunk string, ordinal long")


def stored(store):
    return {(r["collection"], r["chunk_id"]): (r["chunk"], r["ordinal"]) for r in store.read().collect()}


def test_upsert_takes_the_last_of_each_id(spark, tmp_path):
    path = str(tmp_path / "c")
    store = documents.open_collections(spark, path, 8)
    assert store.read().count() == 0 and store.version == 0
    documents.upsert_chunks(store, chunk_rows(spark, [("p", "a", "one", 1), ("p", "a", "three", 3), ("p", "a", "two", 2), ("q", "a", "other", 1), ("p", None, "no id", 1)]))
    assert stored(store) == {("p", "a"): ("three", 3), ("q", "a"): ("other", 1), ("p", None): ("no id", 1)}
    documents.upsert_chunks(store, chunk_rows(spark, [("p", "a", "late", 2), ("p", "b", "new", 1), ("q", "a", "tie b", 5), ("q", "a", "tie a", 5), ("p", None, "again", 2)]))
    expected = {("p", "a"): ("three", 3), ("q", "a"): ("tie b", 5), ("p", "b"): ("new", 1), ("p", None): ("again", 2)}
    assert stored(store) == expected and stored(documents.open_collections(spark, path, 8)) == expected
    documents.upsert_chunks(store, chunk_rows(spark, []))
    assert stored(store) == expected
    buckets.remove(store, spark.createDataFrame([("q", "a"), ("x", "y")], "collection string, chunk_id string"), ("collection", "chunk_id"))
    assert stored(store) == {k: v for k, v in expected.items() if k != ("q", "a")}
    with pytest.raises(ValueError, match="buckets"):
        documents.open_collections(spark, path, 9)


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = documents.open_collections(spark, str(tmp_path / "c"), 16)
    documents.upsert_chunks(store, chunk_rows(spark, [("p", f"id{i}", "x", 0) for i in range(400)]))
    before = set(store.folders())
    old = documents.open_collections(spark, store.path, 16)
    documents.upsert_chunks(store, chunk_rows(spark, [("p", "id7", "y", 1)]))
    assert len(before) == 16 and len(before & set(store.folders())) == 15
    # a reader of the version before still sees it whole
    assert old.read().where("chunk = 'y'").count() == 0 and old.read().count() == 400
    with pytest.raises(buckets.StaleStore):
        documents.upsert_chunks(old, chunk_rows(spark, [("p", "id8", "z", 1)]))
    old.refresh()
    documents.upsert_chunks(old, chunk_rows(spark, [("p", "id8", "z", 1)]))
    store.refresh()
    changed = {r["chunk_id"]: r["chunk"] for r in store.read().where("chunk <> 'x'").collect()}
    assert changed == {"id7": "y", "id8": "z"} and store.read().count() == 400
    assert store.vacuum() == 1 and store.read().count() == 400


def test_upsert_moves_rows_once(spark, tmp_path, monkeypatch):
    plans, write = [], buckets.BucketStore.replace

    def replace(store, rows, touched, **how):
        plans.append((rows._jdf.queryExecution().optimizedPlan().toString(), rows._jdf.queryExecution().executedPlan().toString(), how))
        write(store, rows, touched, **how)

    monkeypatch.setattr(buckets.BucketStore, "replace", replace)
    store = documents.open_collections(spark, str(tmp_path / "c"), 8)
    documents.upsert_chunks(store, chunk_rows(spark, [("p", f"id{i}", "x", 0) for i in range(50)]))
    documents.upsert_chunks(store, chunk_rows(spark, [("p", f"id{i}", "y", 1) for i in range(25)]))
    for _, physical, how in plans:
        assert physical.count("Exchange") == 1 and "rangepartitioning" in physical and how == {"ranged": True}
    # a key repeated very often is reduced before it is dealt by ranges
    many = spark.range(3000).select(F.lit("p").alias("collection"), F.lit("id1").alias("chunk_id"), F.concat(F.lit("v"), "id").alias("chunk"), F.col("id").alias("ordinal"))
    documents.upsert_chunks(store, many)
    assert plans[-1][1].count("Exchange hashpartitioning") == 1
    values = stored(store)
    assert values[("p", "id1")] == ("v2999", 2999) and values[("p", "id2")] == ("y", 1) and values[("p", "id40")] == ("x", 0) and len(values) == 50


def test_many_keys_lie_in_few_files(spark, tmp_path):
    store = documents.open_collections(spark, str(tmp_path / "c"), 8)
    rows = spark.range(200_000).select(F.lit("p").alias("collection"), F.concat(F.lit("id"), "id").alias("chunk_id"), F.lit("x").alias("chunk"), F.lit(0).alias("ordinal"))
    documents.upsert_chunks(store, rows)
    files = store.read().inputFiles()
    assert store.read().count() == 200_000 and len(files) <= 8 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def observations(spark, rows):
    frame = spark.createDataFrame(rows, "region_id string, date date, lat double, lon double, chl_a double")
    return frame.withColumn("turbidity", F.lit(1.0)).withColumn("source", F.lit("s"))


def grid(regions, year=2020, value=1.0):
    return [(f"r{r}", dt.date(year, 1 + d, 3), r * 3 + 0.2 * i, 10.0 + r, value) for r in regions for i in range(5) for d in range(12)]


def test_regions_are_overwritten_wherever_they_were(spark, tmp_path):
    path = str(tmp_path / "o")
    store = obstore.open_store(spark, path, 32)
    obstore.overwrite_regions(store, observations(spark, grid(range(12)) + grid(range(12), 2021)))
    before, live = set(store.folders()), dict(store.live)
    # region 3 moves away and shrinks; its year 2021 and the other regions stay
    moved = [("r3", dt.date(2020, 5, 5), -40.0, 77.0, 9.0)]
    obstore.overwrite_regions(store, observations(spark, moved))
    rows = obstore.observations(store)
    kept = rows.where("region_id = 'r3'").groupBy(F.year("date")).count().collect()
    assert {tuple(r) for r in kept} == {(2020, 1), (2021, 60)} and rows.count() == 12 * 60 * 2 - 59
    assert all(store.live[u] == c for u, c in live.items() if u.endswith("year=2021")) and len(before - set(store.folders())) <= 4
    listed = {r["region_id"]: r for r in obstore.stored_regions(store).collect()}
    assert listed["r3"]["data_points"] == 61 and listed["r3"]["south"] == -40.0 and listed["r0"]["data_points"] == 120
    read = obstore.stored_regions(store).inputFiles()
    assert read and all("/summary/" in file for file in read)
    assert obstore.stored_regions(obstore.open_store(spark, str(tmp_path / "none"), 32)).count() == 0


def test_conditions_reach_folders_and_row_groups(spark, tmp_path):
    store = obstore.open_store(spark, str(tmp_path / "o"), 32)
    obstore.overwrite_regions(store, observations(spark, grid(range(12)) + grid(range(12), 2021)))
    part = obstore.observations(store, ["r1"], "2020-02-01", "2020-03-31", box=(2.9, 10.5, 3.5, 11.5))
    assert part.count() == 6
    plan = part._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in folders and "bucket" in folders and "PushedFilters" in plan and "lat" in plan.split("PushedFilters")[1]


def test_curve_is_a_place_of_its_own_and_keeps_neighbours_near(spark):
    points = [(i * 180.0 / 64 - 90, j * 360.0 / 64 - 180) for i in range(64) for j in range(64)]
    frame = spark.createDataFrame(points, "lat double, lon double").withColumn("c", obstore.curve(F.col("lat"), F.col("lon")))
    rows = frame.orderBy("c").collect()
    assert len({r["c"] for r in rows}) == 4096
    first = rows[:1024]  # a quarter of the curve is a quarter of the globe
    assert {(r["lat"] < 0, r["lon"] < 0) for r in first} == {(True, True)}
    odd = spark.createDataFrame([(91.0, 181.0), (-91.0, -181.0), (None, 1.0)], "lat double, lon double")
    assert [r[0] for r in odd.select(obstore.curve(F.col("lat"), F.col("lon"))).collect()][:2] == [2**32 - 1, 0]


def test_events_read_only_their_places_and_years(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{i % 40}", dt.date(2015 + rng.randrange(8), 1 + rng.randrange(12), 1 + rng.randrange(28)), rng.uniform(-60, 60), rng.uniform(-180, 180), 1.0 * i) for i in range(4000)]
    near = [("near", dt.date(2018, 12, 20), 9.99, 20.0, 1.0), ("near", dt.date(2019, 1, 5), 10.4, 20.5, 2.0), ("near", dt.date(2019, 4, 5), 10.0, 20.0, 3.0), ("near", dt.date(2019, 1, 5), 10.6, 20.0, 4.0)]
    store = obstore.open_store(spark, str(tmp_path / "o"), 64)
    obstore.overwrite_regions(store, observations(spark, rows + near))
    events = spark.createDataFrame([("e1", 10.0, 20.0, dt.date(2019, 1, 10)), ("e2", -45.2, 100.7, dt.date(2017, 6, 6)), ("nowhere", None, 1.0, dt.date(2017, 6, 6)), ("undated", 1.0, 1.0, None)], "name string, lat double, lon double, date date")
    found = obstore.around_events(store, events)
    got = {(r["event"], r["chl_a"]) for r in found.collect()}
    expected = {(e["name"], v) for e in events.collect() if e["lat"] is not None and e["date"] for _, d, lat, lon, v in rows + near
                if abs(lat - e["lat"]) <= 0.5 and abs(lon - e["lon"]) <= 0.5 and abs((d - e["date"]).days) <= 60}
    assert got == expected and {("e1", 1.0), ("e1", 2.0)} <= got
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.split("PartitionFilters")[1].split("PushedFilters")[0].lower()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    read = [p for p in _scans(found) if p["files"]]
    assert read and read[0]["files"] < 0.2 * len(store.read().inputFiles())


def _scans(frame):
    """Files that the scans of a plan read when it was run."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        while (kind := node.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            node = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan()
        metrics = node.metrics()
        if kind == "FileSourceScanExec" and "bucket" in node.toString():
            found.append({"files": metrics.apply("numFiles").value()})
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_validation_from_a_store_equals_that_from_a_table(spark, tmp_path):
    event = dt.date(2020, 6, 15)
    rows = [(f"r{k}", event + dt.timedelta(days=8 * (w - 7)), 40.0 + 0.01 * c, -80.0, 60.0 if w == 8 else 5.0 + 0.3 * ((w * 7 + c) % 3)) for k in range(2) for c in range(3) for w in range(14)]
    table = observations(spark, rows)
    for name in ("sst_delta", "precipitation_7d", "wind_speed"):
        table = table.withColumn(name, F.lit(1.0))
    store = obstore.open_store(spark, str(tmp_path / "o"), 8)
    obstore.overwrite_regions(store, table)
    events = spark.createDataFrame([("bloom", 40.0, -80.0, event, True), ("none", 0.0, 0.0, event, False)], "name string, lat double, lon double, date date, bloom_confirmed boolean")
    direct = validate.event_observations(events, obstore.observations(store))
    by_store = validate.stored_event_observations(events, store)
    assert sorted(by_store.columns) == sorted(direct.columns)
    assert sorted(map(str, by_store.select(*direct.columns).collect())) == sorted(map(str, direct.collect()))
    assert direct.count() == 42
