"""Per-cell features of an observation series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions import votes
from tarnwatch.operators.carry import carry_forward, with_preceding_rows
from tarnwatch.session import stage

CELL = ["region_id", "cell_id"]
ROLLING = [
    "chl_a_rolling_mean", "chl_a_rolling_std", "chl_a_zscore", "chl_a_delta_1w", "chl_a_delta_2w",
]
MODEL_INPUTS = [
    "chl_a_seasonal_residual", "turbidity", "sst_delta", "chl_a_delta_1w", "recent_heavy_rain",
]
CELLS_PER_SLICE = 1 << 20


def rolling_features(
    observations: DataFrame, window_rows: int = 4, slice_by: Column | None = None
) -> DataFrame:
    """Trailing mean, std, z-score and deltas over the previous rows of each cell.

    The frame counts rows, not days, and leaves the current row out so that a spike is not part of
    its own baseline. A cell has one row per date, so a window per cell is bounded by the calendar.
    Series without that guarantee pass ``slice_by`` (for example the year): slices are then
    windowed on their own, with the rows before each slice lent to it.
    """
    keys = list(CELL)
    rows = observations
    order = ["date"]
    if slice_by is not None:
        lent = max(window_rows, 2)
        rows = with_preceding_rows(
            observations.withColumn("_slice", slice_by), CELL, order, "_slice", lent
        )
        keys.append("_slice")
    along = Window.partitionBy(*keys).orderBy(*order)
    trailing = along.rowsBetween(-window_rows, -1)
    chl = F.col("chl_a")
    out = rows.withColumns(
        {
            "chl_a_rolling_mean": F.avg(chl).over(trailing),
            "chl_a_rolling_std": F.stddev_samp(chl).over(trailing),
            "chl_a_delta_1w": chl - F.lag(chl, 1).over(along),
            "chl_a_delta_2w": chl - F.lag(chl, 2).over(along),
        }
    ).withColumn(
        "chl_a_zscore",
        votes.zscore(chl, F.col("chl_a_rolling_mean"), F.col("chl_a_rolling_std")),
    )
    if slice_by is not None:
        out = out.where(~F.col("_borrowed")).drop("_borrowed", "_slice")
    return out


def seasonal_residual(observations: DataFrame) -> DataFrame:
    """Deviation from the mean of the same ISO week in all years of the cell."""
    same_week = Window.partitionBy(*CELL, F.weekofyear("date"))
    return observations.withColumn(
        "chl_a_seasonal_residual", F.col("chl_a") - F.avg("chl_a").over(same_week)
    )


def seasonal_means(observations: DataFrame) -> DataFrame:
    return observations.groupBy(*CELL, F.weekofyear("date").alias("iso_week")).agg(
        F.avg("chl_a").alias("seasonal_mean"), F.count(F.lit(1)).alias("n")
    )


def weather_flags(observations: DataFrame) -> DataFrame:
    return observations.withColumns(
        {
            "recent_heavy_rain": votes.heavy_rain(F.col("precipitation_7d")),
            "high_wind": votes.strong_wind(F.col("wind_speed")),
        }
    )


def _fill_across_cells(features: DataFrame) -> DataFrame:
    """Forward-fill the rolling columns along the cells of a region laid end to end.

    A cell without earlier values of its own takes the last values of the cells before it, in order
    of first date and then arrival. Only one summary row per cell takes part in the region-wide
    fill, and cells are sliced by first date and arrival so that no slice grows with the region.
    """
    arrival = F.struct("date", "ordinal")
    newest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in ROLLING
    ]
    cells = features.groupBy(*CELL).agg(F.min(arrival).alias("_start"), *newest)
    cells = stage(
        cells.select(
            *CELL, F.col("_start.date").alias("_first_date"), F.col("_start.ordinal").alias("_first_ordinal"),
            *ROLLING,
        ),
        "cell-ends",
    )
    slice_by = F.struct("_first_date", F.floor(F.col("_first_ordinal") / CELLS_PER_SLICE))
    order = ["_first_date", "_first_ordinal"]
    filled = carry_forward(cells, ["region_id"], order, ROLLING, slice_by)
    # What reaches a cell is the filled state of the cell before it.
    before = filled.select(
        *CELL, *order, *[F.col(c).alias(f"_in_{c}") for c in ROLLING]
    )
    shifted = _previous_row(before, ["region_id"], order, [f"_in_{c}" for c in ROLLING], slice_by)
    own = Window.partitionBy(*CELL).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        features.join(shifted.select(*CELL, *[f"_in_{c}" for c in ROLLING]), CELL, "left")
        .withColumns(
            {c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"_in_{c}")) for c in ROLLING}
        )
        .drop(*[f"_in_{c}" for c in ROLLING])
    )


def _previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], slice_by: Column
) -> DataFrame:
    """``columns`` taken from the row before, along the order of the key and across its slices."""
    lent = with_preceding_rows(df.withColumn("_slice", slice_by), keys, order, "_slice", 1)
    along = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        lent.withColumns({c: F.lag(c, 1).over(along) for c in columns})
        .where(~F.col("_borrowed"))
        .drop("_borrowed", "_slice")
    )


def fill_rolling(features: DataFrame, scope: str = "cell") -> DataFrame:
    """Forward-fill the rolling columns.

    ``scope="cell"`` never crosses cells, so each keeps its empty warm-up rows. ``scope="region"``
    fills along the concatenated cells of the region, where only the first cell keeps them; it
    needs an ``ordinal`` column holding the arrival order.
    """
    if scope == "region":
        return _fill_across_cells(stage(features, "unfilled"))
    if scope == "cell":
        return carry_forward(features, CELL, ["date"], ROLLING)
    raise ValueError(f"scope must be 'cell' or 'region', not {scope!r}")


def compute_features(
    observations: DataFrame, window_rows: int = 4, scope: str = "cell", slice_by: Column | None = None
) -> DataFrame:
    """All features of the detector; rows that still lack one are dropped at the end.

    The rolling windows come first: they hash-partition by cell, which also serves the fill (in the
    same order, so without another sort) and the seasonal window. The whole step costs one shuffle
    of the observations.
    """
    filled = fill_rolling(rolling_features(observations, window_rows, slice_by), scope)
    complete = weather_flags(seasonal_residual(filled))
    return complete.dropna(subset=[*ROLLING, "chl_a_seasonal_residual"])
