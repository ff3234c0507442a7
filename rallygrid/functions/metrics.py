"""The ratio-of-sums metric suite of a set of player matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallygrid.functions.formulas import half_even, half_even_sql, percent

#: Counters summed over the matches, and the ratios (numerator, denominator) in percent.
COUNTERS = ("ace", "df", "svpt", "first_in", "first_won", "second_won", "service_games", "opp_svpt", "opp_first_in", "opp_first_won", "opp_second_won", "opp_bp_faced", "opp_bp_saved", "bp_saved", "bp_faced", "tb_played", "tb_won", "break_points_generated", "breaks_converted")
RATIOS = {
    "first_in_pct": ("first_in", "svpt"),
    "first_won_pct": ("first_won", "first_in"),
    "second_won_pct": ("second_won", "svpt - first_in"),
    "ace_pct": ("ace", "svpt"),
    "df_pct": ("df", "svpt"),
    "service_points_won_pct": ("first_won + second_won", "svpt"),
    "return_points_won_pct": ("opp_svpt - opp_first_won - opp_second_won", "opp_svpt"),
    "first_return_won_pct": ("opp_first_in - opp_first_won", "opp_first_in"),
    "second_return_won_pct": ("opp_svpt - opp_first_in - opp_second_won", "opp_svpt - opp_first_in"),
    "bp_saved_pct": ("bp_saved", "bp_faced"),
    "bp_converted_pct": ("opp_bp_faced - opp_bp_saved", "opp_bp_faced"),
    "service_hold_pct": ("service_games - bp_faced + bp_saved", "service_games"),
    "tb_won_pct": ("tb_won", "tb_played"),
    "break_conversion_pct": ("breaks_converted", "break_points_generated"),
}
#: Means per match (numerator).
PER_MATCH = {
    "aces_per_match": "ace",
    "double_faults_per_match": "df",
    "service_points_won_per_match": "first_won + second_won",
    "break_points_generated_per_match": "break_points_generated",
    "breaks_converted_per_match": "breaks_converted",
    "tiebreaks_per_match": "tb_played",
}
#: Sums given as they are.
TOTALS = {"losses": "matches - wins", "break_points": "break_points_generated", "breaks": "breaks_converted", "tiebreaks_played": "tb_played", "tiebreaks_won": "tb_won"}


def suite() -> list[Column]:
    """Aggregates: matches, wins, mean minutes and one sum per counter (0 for no known value)."""
    return [
        F.count("*").alias("matches"),
        F.sum("won_match").cast("long").alias("wins"),
        F.avg("minutes").alias("mean_minutes"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
    ]


def ratios() -> list[Column]:
    """The metrics in percent over the sums of ``suite``."""
    return [percent(F.col("wins"), F.col("matches")).alias("win_pct")] + [
        percent(F.expr(a), F.expr(b)).alias(n) for n, (a, b) in RATIOS.items()
    ]


def full_suite() -> list[Column]:
    """All metrics: totals, percentages, means per match and minutes."""
    return [
        *[F.expr(x).cast("long").alias(n) for n, x in TOTALS.items()],
        *ratios(),
        *[half_even(F.expr(x) / F.col("matches"), 2).alias(n) for n, x in PER_MATCH.items()],
        half_even(F.col("mean_minutes"), 2).alias("avg_minutes"),
    ]


def plausible() -> Column:
    """Guard of counters: valid or unknown."""
    serve = (F.col("svpt") > 0) & F.col("first_in").between(0, F.col("svpt"))
    points = (F.col("bp_faced") >= 0) & F.col("bp_saved").between(0, F.col("bp_faced"))
    unknown = lambda a, b: F.col(a).isNull() | F.col(b).isNull()
    return (serve | unknown("svpt", "first_in")) & (points | unknown("bp_faced", "bp_saved"))


SUITE_SQL = "count(*) AS matches, CAST(sum(won_match) AS BIGINT) AS wins, avg(minutes) AS mean_minutes, " + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTERS
)
RATIOS_SQL = f"CASE WHEN matches > 0 THEN {half_even_sql('wins / matches * 100', 2)} END AS win_pct, " + ", ".join(
    f"CASE WHEN ({b}) > 0 THEN {half_even_sql(f'({a}) / ({b}) * 100', 2)} END AS {n}" for n, (a, b) in RATIOS.items()
)
FULL_SQL = ", ".join(
    [
        *[f"CAST({x} AS BIGINT) AS {n}" for n, x in TOTALS.items()],
        RATIOS_SQL,
        *[f"{half_even_sql(f'({x}) / matches', 2)} AS {n}" for n, x in PER_MATCH.items()],
        f"{half_even_sql('mean_minutes', 2)} AS avg_minutes",
    ]
)
PLAUSIBLE_SQL = "((svpt > 0 AND first_in BETWEEN 0 AND svpt) OR svpt IS NULL OR first_in IS NULL) AND ((bp_faced >= 0 AND bp_saved BETWEEN 0 AND bp_faced) OR bp_faced IS NULL OR bp_saved IS NULL)"
