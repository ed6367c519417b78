"""Shape of the physical plans."""

import pytest

import __spark_entry__ as spark_entry

QUERIES = spark_entry.queries()


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "spatial_votes", "spatial_votes_same_date", "facility_nearest30", "nearby_key_lookup", "event_match", "vector_topk",
    "validation_details", "source_coord_enrich", "catalog_dates",
])
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_features_cost_one_shuffle_after_the_weekly_aggregate(spark, sf_dir):
    text = plan(spark, sf_dir, "ffill_features_cell")
    assert text.count("Exchange hashpartitioning") == 2
    # One sort by date serves the rolling windows and the fill, one the seasonal window.
    assert text.count("+- Sort [") == 2


@pytest.mark.parametrize("name", ["catalog_dates", "collection_upsert", "facility_nearest30"])
def test_ranked_filters_run_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(spark, sf_dir, name)


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(spark, sf_dir, "rolling_features")
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_comment" not in schema and "l_partkey" not in schema and "l_quantity" not in schema


def test_no_local_checkpoint_in_the_code():
    from pathlib import Path

    root = Path(spark_entry.__file__).parent / "tarnwatch"
    assert not [f for f in root.rglob("*.py") if "localCheckpoint" in f.read_text() or ".rdd" in f.read_text()]


def test_exploded_covers_are_broadcast_only_when_small(spark):
    from tarnwatch.functions.geo import SphereGrid

    def joined(rows):
        probe = spark.range(rows).selectExpr("id", "id % 80 * 1.0 as lat", "id % 170 * 1.0 as lon")
        cover = SphereGrid(10.0).cover(probe, "lat", "lon", 50.0, 10.0)
        return cover.join(spark.range(10**9).selectExpr("id as _bin"), "_bin")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in joined(100)
    assert "SortMergeJoin" in joined(100_000)
