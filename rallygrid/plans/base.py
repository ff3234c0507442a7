"""Frames that many queries start from, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallygrid.functions.dates import readable_date
from rallygrid.functions.formulas import expected_score, profit
from rallygrid.operators.longform import unpivot_sides
from rallygrid.operators.trailing_totals import once_per_match
from rallygrid.session import table

_DATE_SQL = r"""CASE WHEN regexp_full_match(trim({0}), '\d{{8}}(\.0+)?') THEN CAST(try_strptime(left(trim({0}), 8), '%Y%m%d') AS DATE)
 WHEN regexp_full_match(trim({0}), '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(trim({0}) AS DATE) END"""


def date_sql(column: str) -> str:
    return _DATE_SQL.format(column)


#: Columns in which the deliveries of one player match agree.
_CONTENT = """surface, player, opponent, player_id, opponent_id, won_match, minutes, ace, df, svpt, first_in, first_won, second_won, service_games, opp_svpt,
  opp_first_in, opp_first_won, opp_second_won, opp_bp_faced, opp_bp_saved, bp_saved, bp_faced, tb_played, tb_won, break_points_generated, breaks_converted,
  tourney_level, tourney_name, tourney_id, round"""


def player_matches(spark: SparkSession, d: str) -> DataFrame:
    """Player long form with a readable date, each match once however often it was delivered."""
    return once_per_match(table(spark, d, "analytics_player_matches")).filter("match_day is not null")


PM = f"""pm0 AS (SELECT *, max(day0) OVER (PARTITION BY {_CONTENT}) AS match_day,
  row_number() OVER (PARTITION BY {_CONTENT} ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS delivery
  FROM (SELECT *, {date_sql('tourney_date')} AS day0 FROM analytics_player_matches)
), pm AS (SELECT * FROM pm0 WHERE delivery = 1 AND match_day IS NOT NULL)"""


def matches(spark: SparkSession, d: str) -> DataFrame:
    """The feed with one row per natural key (the latest delivery) and a readable date; rows
    without a key stand for themselves. A pre-aggregated maximum, so a hot key doesn't meet as rows."""
    feed = table(spark, d, "ongoing_tourneys")
    keyless = F.when(F.col("tourney_id").isNull() | F.col("match_num").isNull(), F.col("row_id"))
    rest = [c for c in feed.columns if c not in ("tourney_id", "match_num")]
    latest = F.max_by(F.struct(*rest), F.struct("loaded_at", "row_id"))
    return (
        feed.groupBy("tourney_id", "match_num", keyless.alias("_keyless"))
        .agg(latest.alias("_row"))
        .select("tourney_id", "match_num", "_row.*")
        .withColumn("match_day", readable_date(F.col("tourney_date")))
        .filter("match_day is not null and winner_id is not null and loser_id is not null")
    )


MATCHES = f"""m AS (SELECT *, {date_sql('tourney_date')} AS match_day FROM (
  SELECT *, row_number() OVER (PARTITION BY tourney_id, match_num, CASE WHEN tourney_id IS NULL OR match_num IS NULL THEN row_id END
   ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM ongoing_tourneys) WHERE rn = 1
), matches AS (SELECT * FROM m WHERE match_day IS NOT NULL AND winner_id IS NOT NULL AND loser_id IS NOT NULL)"""


def bets(spark: SparkSession, d: str) -> DataFrame:
    """Mirrored bets from the rating history: the overall ratings give the model's probability,
    the surface ratings the market's, with a margin of 5 % in the odds. A match that was recorded
    again or corrected is one bet: its last fully rated row."""
    known = table(spark, d, "player_elo_history").filter(
        "winner_elo_before is not null and loser_elo_before is not null and winner_surface_elo_before is not null"
        " and loser_surface_elo_before is not null and match_date is not null"
    )
    match = ["match_date", "winner_id", "loser_id"]
    used = ["history_id", "surface", *[f"{w}_{c}" for w in ("winner", "loser") for c in ("elo_before", "surface_elo_before", "days_inactive", "surface_days_inactive")]]
    last = F.max_by(F.struct(*used), F.struct("recorded_at", "history_id"))
    rated = known.groupBy(*match).agg(last.alias("_row")).select(*match, "_row.*")
    w, l = "winner", "loser"
    side = lambda a, b, t: {
        "player": f"{a}_id",
        "opponent": f"{b}_id",
        "target": F.lit(t),
        "delta_elo": F.col(f"{a}_elo_before") - F.col(f"{b}_elo_before"),
        "delta_surface_elo": F.col(f"{a}_surface_elo_before") - F.col(f"{b}_surface_elo_before"),
        "delta_idle": F.col(f"{a}_days_inactive") - F.col(f"{b}_days_inactive"),
        "delta_surface_idle": F.col(f"{a}_surface_days_inactive") - F.col(f"{b}_surface_days_inactive"),
    }
    long = unpivot_sides(rated, ["history_id", "match_date", "surface"], [side(w, l, 1), side(l, w, 0)])
    zero = F.lit(0.0)
    return (
        long.withColumn("p_model", expected_score(F.col("delta_elo"), zero))
        .withColumn("p_market", expected_score(F.col("delta_surface_elo"), zero))
        .withColumn("odds", 1 / (F.col("p_market") * 1.05))
        .withColumn("edge", F.col("p_model") - F.col("p_market"))
        .withColumn("profit", profit(F.col("target"), F.col("odds")))
    )


BETS = """rated AS (SELECT * FROM player_elo_history WHERE winner_elo_before IS NOT NULL AND loser_elo_before IS NOT NULL
  AND winner_surface_elo_before IS NOT NULL AND loser_surface_elo_before IS NOT NULL AND match_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY match_date, winner_id, loser_id ORDER BY recorded_at DESC NULLS LAST, history_id DESC) = 1
), long AS (
  SELECT history_id, match_date, surface, winner_id AS player, loser_id AS opponent, 1 AS target, winner_elo_before - loser_elo_before AS delta_elo,
    winner_surface_elo_before - loser_surface_elo_before AS delta_surface_elo, winner_days_inactive - loser_days_inactive AS delta_idle,
    winner_surface_days_inactive - loser_surface_days_inactive AS delta_surface_idle FROM rated
  UNION ALL
  SELECT history_id, match_date, surface, loser_id, winner_id, 0, loser_elo_before - winner_elo_before,
    loser_surface_elo_before - winner_surface_elo_before, loser_days_inactive - winner_days_inactive,
    loser_surface_days_inactive - winner_surface_days_inactive FROM rated
), b0 AS (SELECT *, 1/(1+pow(10.0, -delta_elo/400.0)) AS p_model, 1/(1+pow(10.0, -delta_surface_elo/400.0)) AS p_market FROM long
), b1 AS (SELECT *, 1/(p_market*1.05) AS odds, p_model - p_market AS edge FROM b0
), bets AS (SELECT *, CASE WHEN target = 1 THEN odds - 1 ELSE -1.0 END AS profit FROM b1)"""
