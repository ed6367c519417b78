"""Scoring of detections, and the suite end to end."""

import datetime as dt

import pytest

from tarnwatch.operators import validate

DETAIL = "name string, expected string, detected boolean, max_z_score double, max_chl_a double, data_points long, error string"


def test_documented_events(spark):
    events = validate.documented_events(spark)
    assert events.count() == 15
    assert events.where("bloom_confirmed").count() == 10


def test_matrix_and_metrics(spark):
    rows = [("bloom", True)] * 3 + [("bloom", False)] + [("clean", False)] * 4 + [("clean", True)] * 2
    matrix = validate.confusion_matrix(spark.createDataFrame(rows, "expected string, detected boolean"))
    assert tuple(matrix.first()) == (3, 1, 4, 2)
    assert validate.metrics(matrix).first().asDict() == {"accuracy": 0.7, "precision": 0.6, "recall": 0.75, "f1_score": 0.6667}
    none = validate.confusion_matrix(spark.createDataFrame([("clean", False)], "expected string, detected boolean"))
    assert validate.metrics(none).first().asDict() == {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1_score": 0.0}


@pytest.mark.parametrize("z, points, error, start", [
    (1.25, 9, None, "Max z-score was 1.2 (below"), (3.0, 9, None, "Z-score reached 3.0 but"),
    (0.0, 0, None, "No satellite data"), (0.0, 3, "Insufficient data: only 3 points", "Pipeline error: Insufficient"),
])
def test_false_negative_reasons(spark, z, points, error, start):
    rows = [("e", "bloom", False, z, 5.0, points, error), ("hit", "bloom", True, 9.0, 9.0, 9, None), ("c", "clean", False, 0.0, 0.0, 9, None)]
    got = validate.false_negatives(spark.createDataFrame(rows, DETAIL)).collect()
    assert [r["event"] for r in got] == ["e"] and got[0]["explanation"].startswith(start)


def test_suite_end_to_end(spark):
    event = dt.date(2020, 6, 15)
    events = spark.createDataFrame(
        [("bloom", 40.0, -80.0, event, True), ("calm", 45.0, -80.0, event, False), ("nothing", 0.0, 0.0, event, True), ("few", 50.0, 0.0, event, False)],
        "name string, lat double, lon double, date date, bloom_confirmed boolean")
    rows = []
    for lat, lon, count in ((40.0, -80.0, 14), (45.0, -80.0, 14), (50.0, 0.0, 1)):
        for c in range(3):
            for w in range(count):
                date = event + dt.timedelta(days=8 * (w - 7))
                chl = 5.0 + 0.3 * ((w * 7 + c) % 3)
                if lat == 40.0 and date == event + dt.timedelta(days=8):
                    chl = 60.0
                rows.append(("all", c, date, lat + 0.01 * c, lon, chl, chl * 0.15, 0.1 * (w % 4), 5.0, 3.0))
    table = spark.createDataFrame(rows, "region_id string, cell_id long, date date, lat double, lon double, chl_a double, turbidity double, sst_delta double, precipitation_7d double, wind_speed double")
    result = validate.run_validation(events, table)
    details = {r["name"]: r for r in result["details"].collect()}
    assert details["bloom"]["detected"] and details["bloom"]["severity"] == "critical" and details["bloom"]["passed"]
    assert not details["calm"]["detected"] and details["calm"]["data_points"] == 42
    assert details["nothing"]["error"] == "No satellite data available for this location/date"
    assert details["few"]["error"] == "Insufficient data: only 3 points" and details["few"]["passed"]
    assert tuple(result["confusion_matrix"].first()) == (1, 1, 2, 0)
    assert [r["event"] for r in result["false_negatives"].collect()] == ["nothing"]
