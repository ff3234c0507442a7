"""Named formulas: ratings, signals, scores, stakes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_RATING = 1500.0
#: e-folding times in days, overall and per surface; base K per tournament level (fixed values).
TAU_OVERALL, TAU_SURFACE = 730.0, 3650.0
BASE_K = {"G": 40.0, "M": 32.0, "500": 28.0}
OTHER_K = 24.0


def half_even(value: Column, digits: int) -> Column:
    """Rounded to ``digits`` places, halves to the even neighbour."""
    return F.rint(value * float(10**digits)) / float(10**digits)


def half_even_sql(value: str, digits: int) -> str:
    return f"round_even(({value}) * {float(10**digits)}::DOUBLE, 0) / {float(10**digits)}::DOUBLE"


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole * 100, null unless whole is positive."""
    return F.when(whole > 0, half_even(part / whole * 100, digits))


def decayed(rating: Column, days: Column, tau: float) -> Column:
    """Exponential pull to the base rating; none without idle days."""
    return F.when(days <= 0, rating).otherwise(BASE_RATING + (rating - BASE_RATING) * F.exp(-days / F.lit(tau)))


def expected_score(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400.0))


def k_factor(level: Column, most_idle: Column) -> Column:
    base = F.lit(OTHER_K)
    for name, k in BASE_K.items():
        base = F.when(level == name, k).otherwise(base)
    return base * F.when(most_idle > 180, 2.0).when(most_idle > 70, 1.5).otherwise(1.0)


def expected_py(a: float, b: float) -> float:
    return 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0))


def decayed_py(rating: float, days: float, tau: float) -> float:
    return rating if days <= 0 else BASE_RATING + (rating - BASE_RATING) * math.exp(-days / tau)


def three_way(value: Column, high: float, medium: float) -> Column:
    """HIGH / MEDIUM / LOW; unknown counts as LOW."""
    return F.when(value >= high, "HIGH").when(value >= medium, "MEDIUM").otherwise("LOW")


def profit(target: Column, odds: Column) -> Column:
    """Unit stake: odds - 1 when won, else -1."""
    return F.when(target == 1, odds - 1).otherwise(F.lit(-1.0))


def confidence_tier(edge: Column) -> Column:
    return F.when(edge >= 0.15, "HIGH").when(edge >= 0.10, "MEDIUM").when(edge >= 0.05, "LOW").otherwise("NONE")
