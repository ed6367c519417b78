"""Per-row scores, votes and labels of the anomaly detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch.functions.geo import number_text, snap

SEVERITY_RANK = {"none": 0, "moderate": 1, "severe": 2, "critical": 3}


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Deviation in units of the std, floored at 1; a missing std stays missing."""
    return (value - mean) / F.when(std.isNotNull(), F.greatest(std, F.lit(1.0)))


def z_flag(z: Column) -> Column:
    return (F.abs(F.coalesce(z, F.lit(0.0))) > 2).cast("double")


def vote(z: Column, iso: Column, spatial: Column) -> Column:
    """Weighted sum of the three flags, in double arithmetic and in this order."""
    return F.lit(0.35) * z + F.lit(0.35) * iso + F.lit(0.30) * spatial


def is_anomaly(z: Column, iso: Column, spatial: Column, exact: bool = False) -> Column:
    """Whether the vote reaches 65 %.

    In doubles 0.35 + 0.30 stays below 0.65, so z-score plus spatial evidence is not enough.
    ``exact`` counts in whole percent instead, where it is.
    """
    if exact:
        return (35 * z + 35 * iso + 30 * spatial) >= 65
    return vote(z, iso, spatial) >= F.lit(0.65)


def severity(z: Column, anomaly: Column) -> Column:
    size = F.abs(z)
    return (
        F.when(~anomaly, "none")
        .when(size > 4, "critical")
        .when(size > 3, "severe")
        .otherwise("moderate")
    )


def severity_rank(label: Column) -> Column:
    ranked = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        ranked = F.when(label == name, rank).otherwise(ranked)
    return ranked


def severity_name(rank: Column) -> Column:
    named = F.lit("none")
    for name, value in SEVERITY_RANK.items():
        named = F.when(rank == value, name).otherwise(named)
    return named


def heavy_rain(precipitation: Column) -> Column:
    return F.when(precipitation > 50, 1).otherwise(0)


def strong_wind(speed: Column) -> Column:
    return F.when(speed > 8, 1).otherwise(0)


def weather_context(rain_flag: Column, wind_flag: Column) -> Column:
    return (
        F.when(rain_flag != 0, "post_rainfall_runoff")
        .when(wind_flag != 0, "wind_driven_resuspension")
        .otherwise("calm_conditions")
    )


def event_id(region: Column, date: Column, lat: Column, lon: Column) -> Column:
    return F.concat_ws(
        "_",
        region.cast("string"),
        F.date_format(date, "yyyy-MM-dd"),
        number_text(snap(lat)),
        number_text(snap(lon)),
    )
