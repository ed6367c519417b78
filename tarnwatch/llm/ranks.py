"""Places of rows in sorted order, without a window over a whole key.

A key may hold a third of all rows, so its rows are never ranked in one task. The table is sorted by
ranges of (key, order), which cut keys anywhere; each sorted piece is numbered where it stands, and
only one summary row per key and piece takes part in adding up what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.session import stage


def ranked(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place ``pos`` (0-based) within ``key`` in ``order``, and ``key_rows``.

    ``rows`` should be cheap to read twice (the sort samples its input first): stage costly ones.
    Null is a key like any other. Rows equal in key and order are taken as they are read. The result
    is a plan over a staged table, so it may be read several times.
    """
    # the tie-breaker lets the sort cut runs of equal rows, too
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.orderBy(F.col(key), *order, "_tie").drop("_tie")
    numbered = stage(ordered.withColumn("_row", F.monotonically_increasing_id()), name)
    piece = F.shiftright("_row", 33)
    sums = numbered.groupBy(F.col(key).alias("_key"), piece.alias("_piece")).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_key", "_piece", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_key")).alias("key_rows"),
    )
    joined = numbered.join(starts, (piece == F.col("_piece")) & F.col(key).eqNullSafe(F.col("_key")))
    place = F.col("_before") + F.col("_row") - F.col("_first")
    return joined.select(*rows.columns, place.alias("pos"), "key_rows")
