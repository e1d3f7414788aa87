"""Column formulas: how busy a moment is, how likely a purchase is reviewed, and with how many stars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.fixed_values import (
    DAYS_PER_YEAR,
    HOLIDAYS,
    NORTHERN_PEAK_DAY,
    REVIEW_BASE_RATE,
    REVIEW_EXTREMITY_RATE,
    REVIEW_RATING_NOISE,
    REVIEW_SHARPNESS,
    SEASONAL_AMPLITUDE,
)


def seasonality_index(when: str, southern: Column, *, amplitude: float = SEASONAL_AMPLITUDE,
                      northern_peak: float = NORTHERN_PEAK_DAY, holidays: list[tuple] = HOLIDAYS) -> Column:
    """Order intensity at a moment relative to the yearly average: a yearly wave plus a burst around each holiday."""
    t = F.col(when)
    day = F.dayofyear(t) + F.hour(t) / 24
    peak = F.when(southern, F.lit(northern_peak + DAYS_PER_YEAR / 2)).otherwise(F.lit(float(northern_peak)))
    level = F.lit(1.0) + F.lit(amplitude) * F.cos((day - peak) * (2 * math.pi) / DAYS_PER_YEAR)
    for month, dom, boost, width in holidays:
        away = F.least(*[
            F.abs(F.timestamp_diff("SECOND", F.make_timestamp_ntz(
                F.year(t) + shift, F.lit(month), F.lit(dom), F.lit(0), F.lit(0), F.lit(0)), t)) / 86_400
            for shift in (-1, 0, 1)])
        level = level + F.lit(boost) * F.exp(F.lit(-0.5) * F.pow(away / width, F.lit(2.0)))
    return level


def peak_seasonality(*, amplitude: float = SEASONAL_AMPLITUDE, holidays: list[tuple] = HOLIDAYS) -> float:
    """An upper bound of the index."""
    return 1 + amplitude + sum(boost for _, _, boost, _ in holidays)


def _checked(base: float, extremity: float, sharpness: float) -> None:
    if not (0 <= base <= 1 and 0 <= base + extremity <= 1):
        raise ValueError("the base rate and the base plus extremity rate must lie in 0..1")
    if sharpness <= 0:
        raise ValueError("sharpness must be above 0")


def review_probability(satisfaction: Column, *, base: float = REVIEW_BASE_RATE,
                       extremity: float = REVIEW_EXTREMITY_RATE, sharpness: float = REVIEW_SHARPNESS) -> Column:
    """The chance that a purchase is reviewed: lowest for the middling, highest at both ends."""
    _checked(base, extremity, sharpness)
    return F.lit(base) + F.lit(extremity) * F.pow(F.abs(satisfaction * 2 - 1), F.lit(sharpness))


def expected_rating(satisfaction: Column, noise: Column, *, spread: float = REVIEW_RATING_NOISE) -> Column:
    """Stars from satisfaction and standard-normal noise, rounded half to even into 1..5."""
    stars = F.bround(F.lit(1.0) + satisfaction * 4 + noise * spread, 0)
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), stars)).cast("tinyint")
