"""Expected chlorophyll by latitude and day of year, and the residual against it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (upper bound on |latitude|, baseline mg/m3), last entry for the rest.
BASELINE_BANDS = [(15, 8.0), (30, 5.5), (50, 4.0), (65, 2.5), (None, 1.5)]
# Fixed values: (upper bound on |latitude|, seasonal amplitude).
AMPLITUDE_BANDS = [(15, 0.15), (30, 0.3), (50, 0.5), (None, 0.35)]
# Fixed values: (height, centre day, width in days) of the spring and autumn pulses.
PULSES = [(1.0, 120, 40), (0.4, 280, 30)]
SOUTHERN_SHIFT_DAYS = 182


def _by_band(lat: Column, bands: list[tuple[int | None, float]]) -> Column:
    chosen = F.lit(bands[-1][1])
    for bound, value in reversed(bands[:-1]):
        chosen = F.when(F.abs(lat) < bound, value).otherwise(chosen)
    return chosen


def baseline_chl(lat: Column) -> Column:
    return _by_band(lat, BASELINE_BANDS)


def seasonal_amplitude(lat: Column) -> Column:
    return _by_band(lat, AMPLITUDE_BANDS)


def expected_chl(lat: Column, day_of_year: Column) -> Column:
    day = F.pmod(day_of_year + F.when(lat >= 0, 0).otherwise(SOUTHERN_SHIFT_DAYS), F.lit(365))
    pulses = [
        F.lit(height) * F.exp(-((day - centre) * (day - centre)) / F.lit(2.0 * width * width))
        for height, centre, width in PULSES
    ]
    return baseline_chl(lat) * (F.lit(1.0) + seasonal_amplitude(lat) * (pulses[0] + pulses[1]))


def climatology_residual(chl: Column, lat: Column, date: Column) -> Column:
    return chl - expected_chl(lat, F.dayofyear(date))
