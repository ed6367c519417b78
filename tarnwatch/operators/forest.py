"""Isolation forest per region (Liu, Ting & Zhou 2008): each tree samples the whole region, rows are scored in blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.operators.features import MODEL_INPUTS
from tarnwatch.operators.quantile import order_statistic
from tarnwatch.session import stage

ROWS_PER_BLOCK = 100_000
SCORING_CHUNK = 8_192


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 2.0)
    length = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, length, np.where(n == 2, 1.0, 0.0))


def grow_trees(points: np.ndarray, trees: int, sample_size: int, rng: np.random.Generator):
    """Grow all trees at once, one level per step.

    Trees are complete binary arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``. A node
    that is not split keeps an infinite threshold, so rows fall to its left-most leaf, which holds
    its path length. Returns ``feature``, ``threshold`` (trees x inner nodes) and ``path``
    (trees x leaves).
    """
    n = len(points)
    drawn = np.argsort(rng.random((trees, n)), axis=1)[:, : min(sample_size, n)]
    return grow_from(points[drawn], rng)


def grow_from(sample: np.ndarray, rng: np.random.Generator):
    """As :func:`grow_trees`, from the rows drawn for each tree (trees x size x inputs)."""
    trees, size, width = sample.shape
    height = int(np.ceil(np.log2(max(size, 2))))
    inner, leaves = 2**height - 1, 2**height
    feature = np.zeros((trees, inner), dtype=np.int8)
    threshold = np.full((trees, inner), np.inf)
    depth = np.zeros((trees, size))
    tree = np.repeat(np.arange(trees), size)
    node = np.zeros(trees * size, dtype=np.int64)
    flat = sample.reshape(-1, width)
    for level in range(height):
        at_level, first = 2**level, 2**level - 1
        slot = tree * at_level + (node - first)
        low = np.full((trees * at_level, width), np.inf)
        high = np.full((trees * at_level, width), -np.inf)
        by_slot = np.argsort(slot, kind="stable")
        taken, starts = np.unique(slot[by_slot], return_index=True)
        low[taken] = np.minimum.reduceat(flat[by_slot], starts)
        high[taken] = np.maximum.reduceat(flat[by_slot], starts)
        splittable = high > low
        draw = np.where(splittable, rng.random(splittable.shape), -1.0)
        pick = draw.argmax(axis=1)
        rows = np.arange(len(pick))
        position = rng.random(len(pick))
        can = splittable.any(axis=1)
        lo, hi = np.where(can, low[rows, pick], 0.0), np.where(can, high[rows, pick], 0.0)
        cut = np.where(can, np.minimum(lo + position * (hi - lo), np.nextafter(hi, -np.inf)), np.inf)
        feature[:, first : first + at_level] = pick.reshape(trees, at_level)
        threshold[:, first : first + at_level] = cut.reshape(trees, at_level)
        went_on = can[slot]
        depth += went_on.reshape(trees, size)
        right = flat[np.arange(len(flat)), pick[slot]] > cut[slot]
        node = 2 * node + 1 + right
    leaf = tree * leaves + (node - inner)
    count = np.bincount(leaf, minlength=trees * leaves)
    deepest = np.zeros(trees * leaves)
    np.maximum.at(deepest, leaf, depth.reshape(-1))
    path = deepest + average_path(count)
    return feature, threshold, path.reshape(trees, leaves), size


def score_points(points: np.ndarray, feature, threshold, path, size: int) -> np.ndarray:
    """Anomaly score in (0, 1]: ``2 ** (-mean path / average path)``."""
    trees, inner = feature.shape
    height = int(np.log2(inner + 1))
    scores = np.empty(len(points))
    for start in range(0, len(points), SCORING_CHUNK):
        chunk = points[start : start + SCORING_CHUNK]
        rows, count = np.arange(len(chunk)), len(chunk)
        # column by column, so a node's input is found at its column's offset plus the row
        by_column = np.ascontiguousarray(chunk.T)
        values, offset = by_column.ravel(), feature.astype(np.int64) * count
        node, at = np.empty(count, np.int64), np.empty(count, np.int64)
        value, cut, right = np.empty(count), np.empty(count), np.empty(count, bool)
        total = np.zeros(count)
        for t in range(trees):
            np.greater(by_column[feature[t, 0]], threshold[t, 0], out=right)
            np.add(right, 1, out=node)
            for _ in range(height - 1):
                offset[t].take(node, out=at, mode="clip")
                at += rows
                values.take(at, out=value, mode="clip")
                threshold[t].take(node, out=cut, mode="clip")
                np.greater(value, cut, out=right)
                node *= 2
                node += 1
                node += right
            node -= inner
            total += path[t].take(node)
        scores[start : start + count] = total / trees
    return np.exp2(-scores / average_path(np.array([size]))[0]) if size > 1 else np.full(len(points), 0.5)


def tree_samples(rows: DataFrame, trees: int, sample_size: int, seed: int) -> DataFrame:
    """For each region and tree its own uniform sample from all rows: ``rows`` with ``tree``, ``priority``.

    A tree draws the ``sample_size`` rows with the smallest priorities, a hash of row and tree. Rows
    that surely lie above are left out where they are read: a row is a candidate of a tree with a
    probability that lets ``sample_size`` and nine standard deviations more pass, given the rows of
    the region. Which tree is the first to take a row follows from one hash (the gap of a Bernoulli
    sequence), so a row that no tree takes, nearly every one, costs one logarithm. Whatever
    the size of a region, a few hundred rows per tree are shuffled.

    Should fewer rows pass than a tree may draw, which happens once in 10 ** 18 trees, all trees of
    the region draw that many.
    """
    counts = rows.groupBy("region_id").agg(F.count(F.lit(1)).alias("_rows"))
    passing = sample_size + 9.0 * sample_size**0.5 + 16.0
    chance = F.least(F.lit(1.0), F.lit(passing) / F.col("_rows"))
    identity = F.xxhash64("region_id", "cell_id", "date", F.lit(seed))

    def unit(*key) -> F.Column:
        """A number in (0, 1) from a hash."""
        return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) * 2.0**-53

    hashed = rows.join(counts, "region_id").withColumns({"_id": identity, "_chance": chance})
    # log(1 - 1) is null in SQL: a row that is sure to pass is taken by the first tree
    first = F.when(F.col("_chance") >= 1.0, F.lit(0.0)).otherwise(F.floor(F.log(unit("_id", F.lit("first"))) / F.log1p(-F.col("_chance"))))
    taken = hashed.withColumn("_first", first).where(F.col("_first") < trees).withColumn("_first", F.col("_first").cast("int"))
    # after the first one every tree decides for itself
    dealt = taken.withColumn("tree", F.explode(F.sequence("_first", F.lit(trees - 1)))).where(
        (F.col("tree") == F.col("_first")) | (unit("_id", "tree") < F.col("_chance"))
    )
    return dealt.withColumn("priority", F.xxhash64("_id", "tree", F.lit("priority"))).drop("_id", "_chance", "_first", "_rows")


def drawn_rows(sample: pd.DataFrame, inputs: list[str], trees: int, sample_size: int) -> np.ndarray:
    """Rows of each tree (trees x size x inputs) from the candidates of one region."""
    ordered = sample.sort_values(["tree", "priority", "cell_id", "date"])
    values = ordered[inputs].to_numpy(dtype=np.float64)
    counts = np.bincount(ordered["tree"].to_numpy(), minlength=trees)
    size = min(sample_size, int(counts.min()))
    starts = np.cumsum(counts) - counts
    return values[starts[:, None] + np.arange(size)]


def fit_forests(
    features: DataFrame, inputs: list[str], trees: int = 100, sample_size: int = 256, seed: int = 42,
) -> DataFrame:
    """One row per region holding its packed trees; every tree draws its rows from the whole region."""
    region = features.schema["region_id"]
    schema = T.StructType([
        T.StructField("region_id", region.dataType),
        T.StructField("trees", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("feature", T.BinaryType()),
        T.StructField("threshold", T.BinaryType()),
        T.StructField("path", T.BinaryType()),
    ])

    def fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        feature, threshold, path, size = grow_from(drawn_rows(sample, inputs, trees, sample_size), rng)
        return pd.DataFrame([{
            "region_id": key[0], "trees": trees, "size": size, "feature": feature.tobytes(),
            "threshold": threshold.tobytes(), "path": path.tobytes(),
        }])

    rows = features.select(
        "region_id", "cell_id", "date", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in inputs]
    )
    return tree_samples(rows, trees, sample_size, seed).groupBy("region_id").applyInPandas(fit, schema)


def isolation_scores(
    features: DataFrame, trees: int = 100, sample_size: int = 256, seed: int = 42
) -> DataFrame:
    """Add ``iso_score``.

    Scoring needs the forest next to the rows. The forests of all regions together grow with the
    data, so they are not broadcast: rows of a region are dealt into blocks of bounded size, the
    forest is copied to each block, and blocks are co-grouped.
    """
    inputs = [c for c in MODEL_INPUTS if c in features.columns]
    forests = fit_forests(features, inputs, trees, sample_size, seed)
    blocks = features.groupBy("region_id").agg(
        F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK).cast("int").alias("_blocks")
    )
    dealt = (
        features.join(blocks, "region_id")
        .withColumn("_block", F.pmod(F.xxhash64("cell_id", "date"), F.col("_blocks")).cast("int"))
        .drop("_blocks")
    )
    copies = forests.join(blocks, "region_id").select(
        *forests.columns, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
    )
    out = T.StructType([*features.schema.fields, T.StructField("iso_score", T.DoubleType())])
    columns = features.columns

    def score(rows: pa.Table, forest: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return rows.select(columns).append_column("iso_score", pa.array([], pa.float64()))
        model = forest.to_pylist()[0]
        count = model["trees"]
        feature = np.frombuffer(model["feature"], np.int8).reshape(count, -1)
        threshold = np.frombuffer(model["threshold"], np.float64).reshape(count, -1)
        path = np.frombuffer(model["path"], np.float64).reshape(count, -1)
        points = np.column_stack(
            [np.nan_to_num(rows[c].to_numpy().astype(np.float64), nan=0.0) for c in inputs]
        )
        scores = score_points(points, feature, threshold, path, model["size"])
        return rows.select(columns).append_column("iso_score", pa.array(scores))

    keys = ["region_id", "_block"]
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(score, out)


def isolation_flags(
    features: DataFrame,
    contamination: float = 0.05,
    trees: int = 100,
    sample_size: int = 256,
    seed: int = 42,
) -> DataFrame:
    """Add ``iso_score`` and ``iso_flag``: 1.0 for the rows of a region that score above its
    ``1 - contamination`` quantile.

    The scored table is staged once: the quantile and the flags both read it.
    """
    scored = stage(isolation_scores(features, trees, sample_size, seed), "iso-scores")
    threshold = order_statistic(scored, ["region_id"], "iso_score", 1.0 - contamination)
    return (
        scored.join(threshold.drop("n"), "region_id")
        .withColumn("iso_flag", F.when(F.col("iso_score") > F.col("threshold"), 1.0).otherwise(0.0))
        .drop("threshold")
    )
