"""Features, gap filling, spatial votes: against plain Python on small tables."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oracle import haversine
from tarnwatch.operators import carry, detect, features, serve, spatial

DAY0 = dt.date(2024, 1, 1)
SERIES = "region_id string, cell_id long, date date, lat double, lon double, chl_a double, turbidity double, sst_delta double, precipitation_7d double, wind_speed double, ordinal long"


def series(spark, cells, weeks, seed=1, regions=1):
    rng = random.Random(seed)
    rows, ordinal = [], 0
    for r in range(regions):
        for c in range(cells):
            first = rng.randrange(3)
            for w in range(first, first + weeks):
                rows.append((f"r{r}", c, DAY0 + dt.timedelta(days=8 * w), 40 + c * 0.05, -80.0, rng.choice([2, 5, 7, 8, 30]) + 0.5,
                             1.0, 0.0, rng.choice([10.0, 60.0]), rng.choice([2.0, 9.0]), ordinal))
                ordinal += 1
    return spark.createDataFrame(rows, SERIES)


def test_rolling_golden(spark):
    rows = [("r", 1, DAY0 + dt.timedelta(days=i), 0.0, 0.0, float(v), 1.0, 0.0, 0.0, 0.0, i) for i, v in enumerate((5, 7, 8, 2))]
    got = features.rolling_features(spark.createDataFrame(rows, SERIES)).orderBy("date").collect()
    assert [r["chl_a_rolling_mean"] for r in got] == [None, 5.0, 6.0, pytest.approx(6.666667, abs=1e-6)]
    assert [r["chl_a_rolling_std"] for r in got] == [None, None, pytest.approx(1.414214, abs=1e-6), pytest.approx(1.527525, abs=1e-6)]
    assert got[1]["chl_a_zscore"] is None
    assert got[3]["chl_a_delta_2w"] == -5.0


@pytest.mark.parametrize("slice_by", ["date", "floor(datediff(date, '2024-01-01') / 20)", "floor(datediff(date, '2024-01-01') / 100)"])
def test_sliced_rolling_equals_whole(spark, slice_by):
    rows = series(spark, 3, 40)
    columns = ["region_id", "cell_id", "date", *features.ROLLING]
    whole = features.rolling_features(rows).select(*columns)
    sliced = features.rolling_features(rows, slice_by=F.expr(slice_by)).select(*columns)
    assert whole.exceptAll(sliced).count() == 0 and sliced.exceptAll(whole).count() == 0
    assert sliced.count() == 120


def fill_by_pandas(rows: pd.DataFrame) -> pd.DataFrame:
    """The region-wide fill: cells end to end, in order of first date and arrival."""
    parts = []
    ordered = rows.sort_values(["date", "ordinal"])
    for cell in ordered["cell_id"].drop_duplicates():
        parts.append(ordered[ordered["cell_id"] == cell].sort_values("date"))
    out = pd.concat(parts, ignore_index=True)
    out[features.ROLLING] = out[features.ROLLING].ffill()
    return out.dropna(subset=features.ROLLING)


def test_region_fill_leaks_between_cells(spark):
    rows = features.rolling_features(series(spark, 6, 5, regions=1))
    # Two cells too short to have values of their own.
    short = rows.where("cell_id < 4 or date < '2024-01-18'")
    want = fill_by_pandas(short.toPandas())
    got = features.fill_rolling(short, "region").dropna(subset=features.ROLLING).toPandas()
    key = ["cell_id", "date"]
    merged = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(merged[0][[*key, *features.ROLLING]], merged[1][[*key, *features.ROLLING]])
    by_cell = features.fill_rolling(short, "cell").dropna(subset=features.ROLLING).toPandas()
    assert len(by_cell) < len(got)


def test_carry_forward_over_slices(spark):
    rng = random.Random(3)
    rows = [(k, i, None if rng.random() < 0.7 else float(i)) for k in range(3) for i in range(500)]
    table = spark.createDataFrame(rows, "k int, i int, v double")
    plain = carry.carry_forward(table, ["k"], ["i"], ["v"])
    sliced = carry.carry_forward(table, ["k"], ["i"], ["v"], F.floor(F.col("i") / 7))
    assert plain.exceptAll(sliced).count() == 0
    assert sliced.count() == len(rows)


def votes_by_hand(rows, radius=10.0, needed=2, same_date=False):
    flags = {}
    for i, a in enumerate(rows):
        near = sum(
            1 for j, b in enumerate(rows)
            if i != j and a[0] == b[0] and abs(b[5]) > 1.5 and (not same_date or a[2] == b[2])
            and haversine(a[3], a[4], b[3], b[4]) <= radius
        )
        flags[a[6]] = 1.0 if abs(a[5]) > 2 and near >= needed else 0.0
    return flags


@pytest.mark.parametrize("same_date", [False, True])
@pytest.mark.parametrize("centre", [(41.0, -83.0), (0.0, 179.99), (84.0, 12.0), (-60.0, -179.98)])
def test_spatial_votes_against_brute_force(spark, centre, same_date):
    rng = random.Random(hash(centre) % 1000)
    rows = []
    places = {}
    for n in range(220):
        region = f"r{n % 2}"
        cell = rng.randrange(60)
        lat, lon = places.setdefault((region, cell), (
            round(centre[0] + rng.uniform(-0.35, 0.35), 4),
            round((centre[1] + rng.uniform(-0.5, 0.5) / math.cos(math.radians(centre[0])) + 180) % 360 - 180, 4)))
        rows.append((region, cell, DAY0 + dt.timedelta(days=rng.randrange(3)), lat, lon, rng.choice([0.5, 1.7, 2.4, -3.0]), n))
    table = spark.createDataFrame(rows, "region_id string, cell_id long, date date, lat double, lon double, chl_a_zscore double, n int")
    # One row per cell and date, as in observations.
    table = table.dropDuplicates(["region_id", "cell_id", "date"]).cache()
    kept = [tuple(r) for r in table.collect()]
    got = {r["n"]: r["spatial_flag"] for r in spatial.spatial_votes(table, same_date=same_date).collect()}
    assert got == votes_by_hand(kept, same_date=same_date)
    assert 0 < sum(got.values()) < len(got)


def test_spatial_votes_with_a_crowded_bin(spark):
    """Most sites in one bin, a few probes at its edge: all flags right, few pairs."""
    rng = random.Random(11)
    rows = [("r", i, DAY0, round(40 + rng.uniform(0, 0.02), 4), round(-80 + rng.uniform(0, 0.02), 4), 2.5, i) for i in range(400)]
    rows += [("r", 1000 + i, DAY0, round(40.02 + 0.02 * i, 4), -79.99, 2.5, 1000 + i) for i in range(12)]
    table = spark.createDataFrame(rows, "region_id string, cell_id long, date date, lat double, lon double, chl_a_zscore double, n int")
    got = {r["n"]: r["spatial_flag"] for r in spatial.spatial_votes(table).collect()}
    assert got == votes_by_hand(rows)


def test_quirk_other_dates_of_a_cell_are_neighbours(spark):
    rows = [("r", 1, DAY0 + dt.timedelta(days=8 * i), 40.0, -80.0, 2.5) for i in range(3)]
    table = spark.createDataFrame(rows, "region_id string, cell_id long, date date, lat double, lon double, chl_a_zscore double")
    assert spatial.spatial_votes(table).agg(F.sum("spatial_flag")).first()[0] == 3.0
    assert spatial.spatial_votes(table, same_date=True).agg(F.sum("spatial_flag")).first()[0] == 0.0


def test_results_do_not_depend_on_partitions(spark):
    rows = series(spark, 8, 30, regions=2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        table = features.compute_features(rows).withColumn("iso_flag", F.lit(1.0))
        results.append(sorted(map(tuple, detect.ensemble(spatial.spatial_votes(table)).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_timeline_worst_severity(spark):
    rows = [("r", DAY0, 1.0, 2.0, 1.0, 0.5, "moderate"), ("r", DAY0, 3.0, 4.0, 2.0, 0.7, "critical"), ("r", DAY0, 3.0, 4.0, 2.0, 0.7, "none")]
    table = spark.createDataFrame(rows, "region_id string, date date, chl_a_value double, chl_a_baseline double, z_score double, confidence double, severity string")
    point = serve.timeline(table).first()
    assert point["severity"] == "critical"
    assert point["chl_a_value"] == 2.333


def test_normal_band_default(spark):
    table = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("b", 0.0)], "region_id string, chl_a_baseline double")
    got = {r["region_id"]: (r["normal_low"], r["normal_high"]) for r in serve.normal_band(table).collect()}
    assert got == {"a": (5.0, 11.0), "b": (0.0, 5.0)}
