"""Queries of the serving functions, in batch over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.functions.metrics import FULL_SQL, SUITE_SQL
from rallygrid.ml import logistic
from rallygrid.operators.nested_records import link_to_container
from rallygrid.plans.base import PM, bets, player_matches
from rallygrid.plans.core_problems import _P6, _payload_nodes
from rallygrid.plans.learning import FEATURES
from rallygrid.plans.players import _RL, ratings_long
from rallygrid.serving import match_features, predict_fixtures, runtime_metrics
from rallygrid.session import cut_lineage, table

LEVELS = ("G", "M", "500", "250", "A", "F")
#: Flat fields of a fixture by their path (fixed values).
FIXTURE = {
    "fixture_id": "id", "date": "date", "tournament": "tournament.name", "surface": "tournament.court.name", "round": "round.name",
    "player1_id": "player1.id", "player1_name": "player1.name", "player1_country": "player1.countryAcr",
    "player2_id": "player2.id", "player2_name": "player2.name", "player2_country": "player2.countryAcr",
    "odds_p1": "odds.k1", "odds_p2": "odds.k2", "total_games": "odds.total", "over_odds": "odds.ktm", "under_odds": "odds.ktb",
    "handicap": "odds.f1", "hcp_p1_odds": "odds.kf1", "hcp_p2_odds": "odds.kf2",
}


def runtime_windows(spark: SparkSession, d: str) -> DataFrame:
    return runtime_metrics(player_matches(spark, d), LEVELS)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_matches").filter("match_date is not null").select(F.col("match_id").alias("event_id"), "player_a_id", "player_b_id", "surface", F.to_date("match_date").alias("day"))


def live_features(spark: SparkSession, d: str) -> DataFrame:
    return match_features(_events(spark, d), ratings_long(spark, d)).withColumnRenamed("event_id", "match_id")


def historical_features(spark: SparkSession, d: str) -> DataFrame:
    return match_features(_events(spark, d), ratings_long(spark, d), historical=True).withColumnRenamed("event_id", "match_id")


def flat_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Singles of both payload forms that have odds, in flat fields, in one pass over the nodes."""
    paths = {f"[].{k}": n for n, k in FIXTURE.items()}
    wanted = F.col("path").isin(*paths, "[].odds")
    found = link_to_container(_payload_nodes(spark, d), "[]", wanted)
    rows = found.groupBy("payload_id", F.col("parent_at").alias("match_pos")).agg(
        F.max((F.col("path") == "[].odds") & (F.col("kind") == "object")).alias("priced"), *[F.max(F.when(F.col("path") == p, F.col("value"))).alias(n) for p, n in paths.items()]
    )
    single = lambda c: ~F.coalesce(F.contains(c, F.lit("/")), F.lit(False))
    return rows.filter(F.col("priced") & single("player1_name") & single("player2_name")).drop("priced")


def daily_model_picks(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(bets(spark, d).select(F.col("target").cast("double").alias("target"), *[F.col(c).cast("double").alias(c) for c in FEATURES]))
    return predict_fixtures(spark, d, logistic(FEATURES).fit(rows), FEATURES, flat_fixtures(spark, d))


QUERIES = {f.__name__: f for f in (runtime_windows, live_features, historical_features, flat_fixtures, daily_model_picks)}

_LEVELS = ", ".join(f"'{x}'" for x in LEVELS)
_EV = "ev AS (SELECT match_id, player_a_id, player_b_id, surface, CAST(match_date AS DATE) AS day FROM training_matches WHERE match_date IS NOT NULL)"
_SIDES = "sides AS (SELECT match_id, surface, day, 'a' AS side, player_a_id AS p FROM ev UNION ALL SELECT match_id, surface, day, 'b', player_b_id FROM ev)"


def _features_sql(when: str, least: str, gap: str) -> str:
    def of(c: str, s: str) -> str:
        return f"max(CASE WHEN side = '{s}' THEN {c} END)"

    columns = ", ".join(f"{of(c, s)} AS {n}_{s}" for n, c in (("elo", "elo"), ("surface_elo", "surface_elo"), ("days_inactive", "days"), ("surface_days_inactive", "sdays")) for s in "ab")
    return f"""WITH {_RL}, {_EV}, {_SIDES},
o AS (SELECT match_id, side, elo, match_date AS seen, CAST({least.format("date_diff('day', match_date, day)")} AS INTEGER) AS days FROM sides LEFT JOIN rl ON rl.player_id = p {when}
 QUALIFY row_number() OVER (PARTITION BY match_id, side ORDER BY match_date DESC NULLS LAST, history_id DESC) = 1),
s AS (SELECT match_id, side, surface_elo, CAST({least.format("date_diff('day', match_date, day)")} AS INTEGER) AS sdays FROM sides JOIN rl ON rl.player_id = p AND rl.surface = sides.surface {when}
 QUALIFY row_number() OVER (PARTITION BY match_id, side ORDER BY match_date DESC, history_id DESC) = 1),
w AS (SELECT o.match_id, {columns}, count(seen) AS known FROM o LEFT JOIN s USING (match_id, side) GROUP BY 1)
SELECT * EXCLUDE (known), elo_a - elo_b AS delta_elo, days_inactive_a - days_inactive_b AS delta_inactivity_days, {gap} AS delta_surface_inactivity_days, surface_elo_a - surface_elo_b AS delta_surface_elo FROM w WHERE known = 2"""


def _field(name: str, key: str) -> str:
    text = f"json_extract_string(m, '$.{key}')"
    if key == "date":
        text = f"CASE WHEN up THEN strftime(CAST({text} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%g') ELSE {text} END"
    return f"CASE WHEN json_type(m, '$.{key}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {text} END AS {name}"


ORACLES = {
    "runtime_windows": f"""WITH {PM}, ok AS (SELECT *, max(match_day) OVER (PARTITION BY player_id, surface) AS newest, row_number() OVER (PARTITION BY player_id, surface ORDER BY match_day DESC, row_id DESC) AS rn
 FROM pm WHERE player_id IS NOT NULL AND surface IS NOT NULL AND tourney_level IN ({_LEVELS})),
w AS (SELECT *, 'CAREER' AS span FROM ok UNION ALL SELECT *, 'LAST_3_MONTHS' FROM ok WHERE match_day >= newest - INTERVAL 3 MONTH UNION ALL SELECT *, 'LAST_6_MONTHS' FROM ok WHERE match_day >= newest - INTERVAL 6 MONTH
 UNION ALL SELECT *, 'LAST_10_MATCHES' FROM ok WHERE rn <= 10),
s AS (SELECT player_id, surface, span, {SUITE_SQL} FROM w GROUP BY 1, 2, 3) SELECT player_id, surface, span, matches, wins, {FULL_SQL} FROM s""",
    "live_features": _features_sql("", "{0}", "surface_days_inactive_a - surface_days_inactive_b"),
    "historical_features": _features_sql("AND rl.match_date <= day", "greatest(0, {0})", "coalesce(surface_days_inactive_a, 0) - coalesce(surface_days_inactive_b, 0)"),
    "flat_fixtures": _P6 + ", f AS (SELECT payload_id, match_pos, " + ", ".join(_field(n, k) for n, k in FIXTURE.items()) + " FROM united WHERE json_type(m, '$.odds') = 'OBJECT')"
    " SELECT * FROM f WHERE NOT coalesce(contains(player1_name, '/'), false) AND NOT coalesce(contains(player2_name, '/'), false)",
}
