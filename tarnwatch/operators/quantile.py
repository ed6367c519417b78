"""Exact order statistics per key without sorting a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_statistic(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, bins: int = 1 << 18
) -> DataFrame:
    """``keys, n, threshold``: the value at 0-based rank ``floor(fraction * (n - 1))``.

    ``value`` lies in [0, 1]. A histogram (aggregated before its shuffle, at most ``bins`` rows
    per key) locates the bin of the rank; only the distinct values of that bin are ranked.
    """
    binned = df.select(
        *keys, F.col(value).alias("_value"), F.floor(F.col(value) * bins).cast("int").alias("_bin")
    )
    histogram = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        histogram.withColumns({"_upto": F.sum("_rows").over(upto), "n": F.sum("_rows").over(whole)})
        .withColumn("_rank", F.floor(F.lit(fraction) * (F.col("n") - 1)))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
        .select(*keys, "_bin", "n", (F.col("_rank") - F.col("_before")).alias("_within"))
    )
    values = (
        binned.join(located, [*keys, "_bin"])
        .groupBy(*keys, "n", "_within", "_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    upto_value = whole.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        values.withColumn("_upto", F.sum("_rows").over(upto_value))
        .where((F.col("_upto") - F.col("_rows") <= F.col("_within")) & (F.col("_within") < F.col("_upto")))
        .select(*keys, "n", F.col("_value").alias("threshold"))
    )
