"""Queries of the general data problems (1, 4, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.operators.as_known import as_known_at
from rallygrid.operators.nested_records import interval_nodes, link_to_container, typed_table
from rallygrid.operators.packed_fields import split_packed
from rallygrid.operators.trailing_totals import once_per_match, trailing_totals
from rallygrid.plans.base import date_sql
from rallygrid.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "ongoing_tourneys"), "row_id", "score")


def _rating_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two rows per history row, one per player, from one scan."""
    side = lambda w: F.struct(
        F.col(f"{w}_id").alias("entity"),
        F.col(f"{w}_elo_before").alias("elo_before"),
        F.col(f"{w}_days_inactive").alias("days_inactive"),
    )
    return (
        table(spark, d, "player_elo_history")
        .select("match_date", "recorded_at", "history_id", F.explode(F.array(side("winner"), side("loser"))).alias("s"))
        .select("s.entity", F.col("match_date").alias("valid_on"), "recorded_at", F.col("history_id").alias("version_id"), "s.elo_before", "s.days_inactive")
    )


def _match_sides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_matches").select(
        F.col("match_id").alias("event_id"),
        F.explode(F.array("player_a_id", "player_b_id")).alias("entity"),
        F.col("match_date").alias("at"),
    )


def p4_known_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Each player of each match with the rating known at that time."""
    return as_known_at(_match_sides(spark, d), _rating_versions(spark, d)).select(
        F.col("event_id").alias("match_id"), F.col("entity").alias("player_id"), F.col("version_id").alias("history_id"),
        F.col("valid_on").alias("rating_date"), "elo_before", F.col("days_inactive").cast("long").alias("days_inactive"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    versions = _rating_versions(spark, d).drop("elo_before", "days_inactive")
    return as_known_at(_match_sides(spark, d), versions).select(
        F.col("event_id").alias("match_id"), F.col("entity").alias("player_id"), F.col("version_id").alias("history_id")
    )


def _payload_nodes(spark: SparkSession, d: str) -> DataFrame:
    keep = {"ignoreNullFields": "false"}
    upcoming = table(spark, d, "upcoming_matches").select("payload_id", F.to_json("matches", keep).alias("body"))
    raw = table(spark, d, "fixtures_atp").select("payload_id", "body")
    return interval_nodes(upcoming.unionByName(raw), "payload_id", F.col("body"))


#: Result field by the path of its node.
P6_FIELDS = {
    "[].tournament.court.name": "court",
    "[].odds.k1": "k1",
    "[].player1.name": "player1",
    "[].player2.name": "player2",
}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = _payload_nodes(spark, d)
    leaf = F.col("path").isin(*P6_FIELDS) & F.col("value").isNotNull()
    found = link_to_container(nodes, "[]", leaf)
    name = F.create_map(*[F.lit(x) for pair in P6_FIELDS.items() for x in pair])[F.col("path")]
    thousandth = F.round(F.col("value").try_cast("decimal(30,9)") * 1000, 0).cast("long").cast("string")
    return found.select(
        "payload_id",
        F.col("parent_at").cast("int").alias("match_pos"),
        name.alias("field_name"),
        F.when(F.col("path") == "[].odds.k1", thousandth).otherwise(F.col("value")).alias("field_value"),
    ).filter("field_value is not null")


#: All scalar fields of both payload forms, by type: column -> key below the node.
P6_PLAYER = {"id": "id", "name": "name", "country": "countryAcr", "odd": "odd", "seed": "seed", "image": "image", "image_p_name": "image_p_name"}
#: A country is a text in one form and an object in the other.
P6_TOURNAMENT = {
    "id": "id", "name": "name", "date": "date", "rank_id": "rankId", "rank": "rank", "court_id": "courtId",
    "country": "country", "country_acr": "countryAcr", "country_acronym": "country.acronym", "country_name": "country.name",
}
P6_COURT = {"id": "id", "name": "name"}
P6_ODDS = {
    "k1": "k1", "k2": "k2", "total": "total", "ktb": "ktb", "ktm": "ktm", "id_b_o": "id_b_o", "id1_o": "id1_o", "id2_o": "id2_o",
    "f1": "f1", "kf1": "kf1", "k20": "k20", "k21": "k21",
}
P6_MATCH = {
    "id": "id", "date": "date", "round_id": "roundId", "round_name": "round.name", "round_own_id": "round.id", "type": "type", "rank": "rank",
    "court": "court", "h2h": "h2h", "tournament_id": "tournamentId", "player1_id": "player1Id", "player2_id": "player2Id",
    "seed1": "seed1", "seed2": "seed2", "time_game": "timeGame", "live": "live",
}


#: Labels of a node serve the links; the flat tables keep the payload and the position in its list.
def p6_players(spark: SparkSession, d: str) -> DataFrame:
    nodes = _payload_nodes(spark, d)
    sides = [typed_table(nodes, f"[].player{i}", P6_PLAYER).withColumn("side", F.lit(i)) for i in (1, 2)]
    return sides[0].unionByName(sides[1]).drop("pre", "post")


def p6_tournaments(spark: SparkSession, d: str) -> DataFrame:
    return typed_table(_payload_nodes(spark, d), "[].tournament", P6_TOURNAMENT).drop("pre", "post")


def p6_courts(spark: SparkSession, d: str) -> DataFrame:
    return typed_table(_payload_nodes(spark, d), "[].tournament.court", P6_COURT).drop("pre", "post")


def p6_odds(spark: SparkSession, d: str) -> DataFrame:
    return typed_table(_payload_nodes(spark, d), "[].odds", P6_ODDS).drop("pre", "post")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return typed_table(_payload_nodes(spark, d), "[]", P6_MATCH).drop("pre", "post")


def p7_trailing_totals(spark: SparkSession, d: str) -> DataFrame:
    matches = once_per_match(table(spark, d, "analytics_player_matches"))
    return trailing_totals(matches, "player_id", F.col("match_day"), ("ace", "svpt", "won_match"), (7, 30))


QUERIES = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p4_known_ratings": p4_known_ratings,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p6_players": p6_players,
    "p6_tournaments": p6_tournaments,
    "p6_courts": p6_courts,
    "p6_odds": p6_odds,
    "p7_trailing_totals": p7_trailing_totals,
}

_P4 = """
WITH sides AS (
  SELECT match_id, match_date, unnest([player_a_id, player_b_id]) AS player_id FROM training_matches
), hist AS (
  SELECT history_id, match_date AS d, recorded_at, winner_id AS p, winner_elo_before AS elo, winner_days_inactive AS idle FROM player_elo_history
  UNION ALL
  SELECT history_id, match_date, recorded_at, loser_id, loser_elo_before, loser_days_inactive FROM player_elo_history
), hit AS (
  SELECT s.match_id, s.player_id, h.*, row_number() OVER (PARTITION BY s.match_id, s.player_id ORDER BY h.d DESC, h.recorded_at DESC, h.history_id DESC) AS rn
  FROM sides s JOIN hist h ON h.p = s.player_id AND h.d < CAST(s.match_date AS DATE) AND h.recorded_at <= s.match_date
)
"""

_P6 = r"""
WITH raw AS (
  SELECT payload_id, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'VARCHAR' THEN json_extract_string(body, '$') ELSE body END END AS b FROM fixtures_atp
), lists AS (
  SELECT payload_id, CASE WHEN json_valid(b) THEN CASE json_type(b) WHEN 'ARRAY' THEN CAST(b AS JSON) ELSE coalesce(json_extract(b, '$.data'), json_extract(b, '$.fixtures'), json_extract(b, '$.results')) END END AS l FROM raw
), united AS (
  SELECT payload_id, CAST(i AS INTEGER) AS match_pos, json_extract(l, '$[' || (i - 1) || ']') AS m, false AS up
  FROM lists, LATERAL (SELECT unnest(range(1, CAST(json_array_length(l) AS BIGINT) + 1)) AS i)
  UNION ALL
  SELECT payload_id, CAST(generate_subscripts(matches, 1) AS INTEGER), to_json(unnest(matches)), true FROM upcoming_matches
)
"""


def _p6_sql(fields: dict[str, str], at: str = "", more: str = "") -> str:
    def value(key: str) -> str:
        text = f"json_extract_string(m, '$.{at}{key}')"
        if key == "date":
            text = f"CASE WHEN up THEN strftime(CAST({text} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%g') ELSE {text} END"
        return f"CASE WHEN json_type(m, '$.{at}{key}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {text} END"

    where = f"json_type(m, '$.{at[:-1]}') = 'OBJECT'" if at else "json_type(m) = 'OBJECT'"
    return f"SELECT payload_id, match_pos{more}, " + ", ".join(f"{value(k)} AS {n}" for n, k in fields.items()) + f" FROM united WHERE {where}"


_SAME = "player_id, opponent_id, tourney_id, round"
_REST = "surface, player, opponent, tourney_level, tourney_name, won_match, minutes, ace, df, svpt, first_in, first_won, second_won, service_games, opp_svpt, opp_first_in, opp_first_won, opp_second_won, opp_bp_faced, opp_bp_saved, bp_saved, bp_faced, tb_played, tb_won, break_points_generated, breaks_converted"
_MEASURES = ("ace", "svpt", "won_match")
_P7 = f"""
WITH r AS (SELECT *, {date_sql('tourney_date')} AS d FROM analytics_player_matches),
once AS (SELECT {_SAME}, {_REST}, max(d) AS d FROM r GROUP BY ALL),
daily AS (SELECT player_id, d, count(*) AS n, {', '.join(f"coalesce(sum({m}), 0) AS s_{m}, count({m}) AS c_{m}" for m in _MEASURES)} FROM once WHERE player_id IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
span AS (SELECT player_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY player_id),
dense AS (SELECT span.player_id, day, coalesce(n, 0) AS n, {', '.join(f"coalesce(s_{m}, 0) AS s_{m}, coalesce(c_{m}, 0) AS c_{m}" for m in _MEASURES)} FROM span LEFT JOIN daily ON daily.player_id = span.player_id AND daily.d = span.day)
SELECT player_id, day, {', '.join(f"CAST(sum(n) OVER w{p} AS BIGINT) AS events_{p}, " + ', '.join(f"CAST(sum(s_{m}) OVER w{p} AS BIGINT) AS {m}_sum_{p}, CASE WHEN sum(c_{m}) OVER w{p} > 0 THEN sum(s_{m}) OVER w{p} / sum(c_{m}) OVER w{p} END AS {m}_avg_{p}, sum(s_{m}) OVER w{p} / {float(p)} AS {m}_daily_{p}" for m in _MEASURES) for p in (7, 30))}
FROM dense WINDOW w7 AS (PARTITION BY player_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY player_id ORDER BY day ROWS 29 PRECEDING)
"""

ORACLES = {
    "p1_found": r"""
WITH parts AS (
  SELECT row_id, regexp_extract_all(score,
    '"(?:[^"]|"")*"|''[^'']*''|\[[^\]]*\]|(?i:w/o)|[^\s\x{a0};,|/("'']+(?:[\s\x{a0}]*\([^()]*\))*') AS p
  FROM ongoing_tourneys WHERE score IS NOT NULL
), flat AS (SELECT row_id, generate_subscripts(p, 1) AS pos, unnest(p) AS raw FROM parts)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY pos) AS INTEGER) AS pos, piece FROM (
  SELECT row_id, pos, trim(CASE WHEN raw LIKE '"%"' THEN replace(raw[2:-2], '""', '"')
                                WHEN raw LIKE '''%''' THEN raw[2:-2] ELSE raw END) AS piece FROM flat
) WHERE piece <> ''
""",
    "p4_found": _P4 + "SELECT match_id, player_id, history_id FROM hit WHERE rn = 1",
    "p4_known_ratings": _P4
    + "SELECT match_id, player_id, history_id, d AS rating_date, elo AS elo_before, CAST(idle AS BIGINT) AS days_inactive FROM hit WHERE rn = 1",
    "p6_found": r"""
WITH raw AS (
  SELECT payload_id, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'VARCHAR' THEN json_extract_string(body, '$') ELSE body END END AS b FROM fixtures_atp
), lists AS (
  SELECT payload_id, CASE WHEN json_valid(b) THEN CASE json_type(b) WHEN 'ARRAY' THEN CAST(b AS JSON) ELSE coalesce(json_extract(b, '$.data'), json_extract(b, '$.fixtures'), json_extract(b, '$.results')) END END AS l FROM raw
), each AS (
  SELECT payload_id, CAST(i AS INTEGER) AS match_pos, json_extract(l, '$[' || (i - 1) || ']') AS m FROM lists, LATERAL (SELECT unnest(range(1, CAST(json_array_length(l) AS BIGINT) + 1)) AS i)
), flat AS (
  SELECT payload_id, match_pos, json_extract_string(m, '$.tournament.court.name') AS court, json_extract_string(m, '$.odds.k1') AS k1, json_extract_string(m, '$.player1.name') AS p1, json_extract_string(m, '$.player2.name') AS p2 FROM each
), up AS (
  SELECT payload_id, CAST(generate_subscripts(matches, 1) AS INTEGER) AS match_pos, unnest(matches) AS m FROM upcoming_matches
), united AS (
  SELECT * FROM flat UNION ALL SELECT payload_id, match_pos, m.tournament.court.name, CAST(m.odds.k1 AS VARCHAR), m.player1.name, m.player2.name FROM up
), names AS (
  SELECT payload_id, match_pos, 'court' AS field_name, court AS field_value FROM united
  UNION ALL SELECT payload_id, match_pos, 'k1', CAST(CAST(round(try_cast(k1 AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR) FROM united
  UNION ALL SELECT payload_id, match_pos, 'player1', p1 FROM united UNION ALL SELECT payload_id, match_pos, 'player2', p2 FROM united
) SELECT * FROM names WHERE field_value IS NOT NULL
""",
    "p6_matches": _P6 + _p6_sql(P6_MATCH),
    "p6_players": _P6 + _p6_sql(P6_PLAYER, "player1.", ", 1 AS side") + " UNION ALL " + _p6_sql(P6_PLAYER, "player2.", ", 2 AS side"),
    "p6_tournaments": _P6 + _p6_sql(P6_TOURNAMENT, "tournament."),
    "p6_courts": _P6 + _p6_sql(P6_COURT, "tournament.court."),
    "p6_odds": _P6 + _p6_sql(P6_ODDS, "odds."),
    "p7_trailing_totals": _P7,
}
