"""Invariants of the isolation forest and the exact order statistic."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import forest
from tarnwatch.operators.quantile import order_statistic

SCHEMA = "region_id string, cell_id long, date date, chl_a_seasonal_residual double, turbidity double, sst_delta double, chl_a_delta_1w double, recent_heavy_rain int"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for region, n in (("big", 3000), ("small", 40), ("tiny", 1)):
        for i in range(n):
            rows.append((region, i % 50, dt.date(2000, 1, 1) + dt.timedelta(days=i // 50), *(float(v) for v in rng.normal(size=4)), int(rng.random() < 0.2)))
    rows.append(("big", 999, dt.date(2001, 1, 1), 40.0, 40.0, 40.0, 40.0, 1))
    rows.append(("small", 999, dt.date(2001, 1, 1), 40.0, None, 40.0, 40.0, 1))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def flagged(points):
    return forest.isolation_flags(points).toPandas()


def test_scores_and_shares(flagged, points):
    assert len(flagged) == points.count()
    assert ((flagged["iso_score"] > 0) & (flagged["iso_score"] <= 1)).all()
    share = flagged.groupby("region_id")["iso_flag"].mean()
    assert 0.04 <= share["big"] <= 0.05 + 1e-9
    assert share["tiny"] == 0.0


def test_planted_outlier_scores_highest(flagged):
    for region in ("big", "small"):
        part = flagged[flagged["region_id"] == region]
        assert part.loc[part["iso_score"].idxmax(), "cell_id"] == 999
        assert part.loc[part["cell_id"] == 999, "iso_flag"].tolist() == [1.0]


def test_same_seed_same_result_whatever_the_partitions(spark, points, flagged):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = forest.isolation_flags(points.repartition(3)).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    key = ["region_id", "cell_id", "date"]
    a, b = (f.sort_values(key).reset_index(drop=True)[[*key, "iso_score", "iso_flag"]] for f in (flagged, again))
    assert a.equals(b)


def test_blocks_do_not_change_scores(points, flagged, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_PER_BLOCK", 100)
    again = forest.isolation_scores(points).toPandas()
    key = ["region_id", "cell_id", "date"]
    a, b = (f.sort_values(key).reset_index(drop=True)[[*key, "iso_score"]] for f in (flagged, again))
    assert a.equals(b)


def test_trees_isolate_their_sample():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(64, 3))
    feature, threshold, path, size = forest.grow_trees(data, 10, 256, rng)
    assert size == 64 and path.shape == (10, 64) and feature.shape == threshold.shape == (10, 63)
    constant = forest.grow_trees(np.ones((20, 3)), 5, 256, rng)
    scores = forest.score_points(np.ones((4, 3)), *constant)
    assert np.allclose(scores, 0.5)


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_order_statistic(spark, fraction):
    rng = np.random.default_rng(8)
    data = {k: np.round(rng.random(n), 3 if k == 1 else 9) for k, n in ((0, 1), (1, 5000), (2, 777))}
    rows = [(k, float(v)) for k, values in data.items() for v in values]
    table = spark.createDataFrame(rows, "k int, v double")
    for bins in (4, 1 << 18):
        got = {r["k"]: (r["n"], r["threshold"]) for r in order_statistic(table, ["k"], "v", fraction, bins).collect()}
        want = {k: (len(v), float(np.sort(v)[int(np.floor(fraction * (len(v) - 1)))])) for k, v in data.items()}
        assert got == want


def test_every_tree_draws_from_all_rows(spark):
    rows = spark.range(40_000).selectExpr("'r' || (id % 3 = 0) as region_id", "id as cell_id", "date'2020-01-01' as date", "cast(id as double) as v")
    sample = forest.tree_samples(rows, 100, 256, 42).toPandas()
    sizes = {r["region_id"]: r["n"] for r in rows.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for region, part in sample.groupby("region_id"):
        per_tree = part.groupby("tree").size()
        # candidates are few, and never fewer than a tree draws
        assert len(per_tree) == 100 and per_tree.min() >= 256 and per_tree.max() < 600
        assert not part.duplicated(["tree", "cell_id"]).any()
        drawn = forest.drawn_rows(part, ["v"], 100, 256)[:, :, 0]
        assert drawn.shape == (100, 256) and all(len(set(d)) == 256 for d in drawn)
        # uniform over the region, and trees draw independently of each other
        place = np.sort(drawn.ravel()) / 40_000
        assert np.abs(place - np.linspace(0, 1, len(place))).max() < 0.02
        shared = len(set(drawn[0]) & set(drawn[1]))
        assert shared < 8 * 256**2 / sizes[region] + 8
        assert len(set(drawn.ravel())) > 0.8 * sizes[region] * (1 - np.exp(-25_600 / sizes[region]))


def test_trees_are_decided_in_compiled_code(spark):
    rows = spark.range(10).select(F.lit("r").alias("region_id"), F.col("id").alias("cell_id"), F.lit("2020-01-01").cast("date").alias("date"))
    sample = forest.tree_samples(rows, 20, 256, 1)
    # lambdas over arrays are interpreted, which made one hash per row and tree the slowest step
    assert "lambda" not in sample._jdf.queryExecution().optimizedPlan().toString()
    assert sample.groupBy("cell_id").agg(F.countDistinct("tree").alias("n")).where("n = 20").count() == 10


def test_small_regions_are_drawn_whole(spark):
    rows = spark.range(300).selectExpr("case when id < 10 then 'small' else 'most' end as region_id", "id as cell_id", "date'2020-01-01' as date", "cast(id as double) as v")
    sample = forest.tree_samples(rows, 20, 256, 1).toPandas()
    small = forest.drawn_rows(sample[sample["region_id"] == "small"], ["v"], 20, 256)
    assert small.shape == (20, 10, 1) and all(set(d) == set(range(10)) for d in small[:, :, 0])
    most = forest.drawn_rows(sample[sample["region_id"] == "most"], ["v"], 20, 256)
    assert most.shape == (20, 256, 1) and len(set(most.ravel())) == 290
