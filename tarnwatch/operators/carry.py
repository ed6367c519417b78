"""Order-dependent operators that stay bounded when one key holds most of the rows.

A window partitioned by the key alone sends all rows of a key to one task. Where a key has no
natural bound, the rows of the key are cut into slices along the order; each slice is processed on
its own and receives the few rows or values it needs from the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    slice_by: Column | None = None,
) -> DataFrame:
    """Replace nulls in ``columns`` by the last non-null value earlier in the order of the key.

    ``slice_by`` must not decrease along ``order``. With it, the last non-null value of each
    slice is aggregated first (map-side combine), the small slice table is filled along the key,
    and only slices are sorted as a whole.
    """
    if slice_by is None:
        seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})

    sliced = df.withColumn("_slice", slice_by)
    place = F.struct(*order)
    ends = sliced.groupBy(*keys, "_slice").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_carry_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns(
        {f"_carry_{c}": F.last(f"_carry_{c}", ignorenulls=True).over(earlier) for c in columns}
    )
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = sliced.join(carried, [*keys, "_slice"])
    return joined.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_carry_{c}"))
            for c in columns
        }
    ).select(*df.columns)


def with_preceding_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_column: str, rows: int
) -> DataFrame:
    """Add to every slice of a key the ``rows`` rows before it, marked ``_borrowed``.

    A row frame of that length evaluated per (key, slice) then gives what it would give on the
    whole key. Only the last ``rows`` rows of a slice can be borrowed, and the ranked filter that
    finds them is applied before the shuffle as well as after it.
    """
    newest_first = Window.partitionBy(*keys, slice_column).orderBy(*[F.desc(c) for c in order])
    tails = (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= rows)
    )
    # The oldest tail row of a slice is preceded, among tails, by exactly the rows before the slice.
    along_key = Window.partitionBy(*keys).orderBy(slice_column, F.desc("_rank"))
    first_in_slice = F.coalesce(F.lag(slice_column).over(along_key) != F.col(slice_column), F.lit(True))
    lent = (
        tails.withColumn("_first", first_in_slice)
        .withColumn(
            "_lent",
            F.collect_list(F.struct(*df.columns)).over(along_key.rowsBetween(-rows, -1)),
        )
        .where("_first")
        .select(F.col(slice_column).alias("_target"), F.explode("_lent").alias("_row"))
        .select("_row.*", "_target")
        .withColumn(slice_column, F.col("_target"))
        .drop("_target")
        .withColumn("_borrowed", F.lit(True))
    )
    return df.withColumn("_borrowed", F.lit(False)).unionByName(lent)
