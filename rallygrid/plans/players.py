"""Queries on player form, metrics, head to head and point-in-time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallygrid.functions.formulas import BASE_RATING, TAU_OVERALL, TAU_SURFACE, k_factor, three_way
from rallygrid.functions.metrics import FULL_SQL, PLAUSIBLE_SQL, RATIOS_SQL, SUITE_SQL, full_suite, plausible, ratios, suite
from rallygrid.operators.elo import elo_fold
from rallygrid.operators.longform import winner_loser_rows
from rallygrid.operators.windows import before_date_last_n, days_since_last, last_n, rows_before
from rallygrid.plans.base import MATCHES, PM, matches, player_matches
from rallygrid.session import cut_lineage, table



def _newest():
    return [F.col("match_day").desc(), F.col("row_id").desc()]


def form_last10(spark: SparkSession, d: str) -> DataFrame:
    """Form of each player on each surface over the last 10 matches, ranked by score."""
    rows = last_n(player_matches(spark, d).filter("surface is not null"), ["player_id", "surface"], _newest(), 10)
    form = rows.groupBy("player_id", "surface").agg(*suite()).select("player_id", "surface", "matches", *ratios())
    score = 0.5 * F.col("win_pct") + 0.3 * F.coalesce("first_won_pct", F.lit(0.0)) + 0.2 * F.coalesce("second_won_pct", F.lit(0.0))
    return form.select(
        "player_id", "surface", "matches", "win_pct", "first_won_pct", "second_won_pct",
        three_way(F.col("win_pct"), 75, 55).alias("form"), F.round(score, 4).alias("score"),
    ).filter("matches >= 3")


def form_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best forms."""
    return form_last10(spark, d).orderBy(F.col("score").desc_nulls_last(), "player_id", "surface").limit(20)


def rolling_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean counts over the last 10 matches per player and surface."""
    rows = last_n(player_matches(spark, d).filter("surface is not null"), ["player_id", "surface"], _newest(), 10)
    mean = lambda c: F.round(F.avg(c), 4).alias(f"mean_{c}")
    return rows.groupBy("player_id", "surface").agg(
        F.count("*").alias("n"), *[mean(c) for c in ("won_match", "minutes", "ace", "df", "first_in", "first_won", "second_won", "bp_saved")]
    )


def signal_labels(spark: SparkSession, d: str) -> DataFrame:
    """Three-way labels on form; workload high from 150 minutes, serve from 70."""
    r = rolling_metrics(spark, d)
    return r.select(
        "player_id", "surface",
        three_way(F.col("mean_won_match") * 100, 75, 55).alias("form"),
        three_way(F.col("mean_minutes"), 150, 110).alias("fatigue"),
        F.when(F.col("mean_second_won") < 45, "HIGH").when(F.col("mean_second_won") < 52, "MEDIUM").otherwise("LOW").alias("second_serve_risk"),
        three_way(F.col("mean_first_in"), 70, 65).alias("serve"),
    )


def prediction_score(spark: SparkSession, d: str) -> DataFrame:
    s = player_matches(spark, d).filter("surface is not null").groupBy("player_id", "surface").agg(*suite()).select("player_id", "surface", *ratios())
    score = 0.5 * F.col("win_pct") + 0.2 * F.col("first_won_pct") + 0.15 * F.col("second_won_pct") + 0.15 * F.col("bp_saved_pct")
    return s.select("player_id", "surface", F.round(score, 4).alias("prediction_score"))


def surface_metrics(spark: SparkSession, d: str) -> DataFrame:
    return player_matches(spark, d).filter("surface is not null").groupBy("player_id", "surface").agg(*suite()).select(
        "player_id", "surface", "matches", "wins", *ratios()
    )


#: Level groups; a level may be in several.
GROUPS = {"ALL": ("G", "M", "A", "500", "250", "C", "F", "D"), "ATP_SLAM": ("A", "M", "G"), "CHALLENGER": ("C",)}


def player_metrics_windows(spark: SparkSession, d: str) -> DataFrame:
    """The metric suite per player, level group and window (career, last 3 and 6 months up to
    the newest date of all), groups of under three matches left out."""
    rows = player_matches(spark, d).filter(plausible())
    newest = rows.agg(F.max("match_day").alias("newest"))
    groups = F.array_compact(F.array(*[F.when(F.col("tourney_level").isin(*v), F.lit(k)) for k, v in GROUPS.items()]))
    spans = F.array_compact(
        F.array(
            F.lit("CAREER"),
            F.when(F.col("match_day") >= F.add_months("newest", -3), "3M"),
            F.when(F.col("match_day") >= F.add_months("newest", -6), "6M"),
        )
    )
    return (
        rows.join(F.broadcast(newest))  # one row
        .withColumn("level_group", F.explode(groups))
        .withColumn("span", F.explode(spans))
        .groupBy("player_id", "level_group", "span")
        .agg(*suite())
        .filter("matches >= 3")
        .select("player_id", "level_group", "span", "matches", "wins", *full_suite())
    )


def own_latest_window(spark: SparkSession, d: str) -> DataFrame:
    """Matches and wins in the three months up to the player's own newest date."""
    daily = player_matches(spark, d).filter("player_id is not null").groupBy("player_id", "match_day").agg(
        F.count("*").alias("n"), F.sum("won_match").cast("long").alias("won")
    )
    # Days per player, not matches: bounded by the calendar.
    newest = daily.withColumn("newest", F.max("match_day").over(Window.partitionBy("player_id")))
    rows = newest.filter(F.col("match_day") >= F.add_months("newest", -3))
    return rows.groupBy("player_id").agg(F.sum("n").alias("matches"), F.sum("won").alias("wins"))


def coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    return player_matches(spark, d).groupBy(F.year("match_day").cast("long").alias("year")).agg(
        F.count("*").alias("n"), *[F.round(F.count(c) / F.count("*") * 100, 4).alias(f"{c}_pct") for c in ("ace", "svpt", "minutes", "bp_saved", "surface")]
    )


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.least("winner_id", "loser_id"), F.greatest("winner_id", "loser_id")
    return matches(spark, d).select(
        a.alias("a"), b.alias("b"), "surface", "match_day", "row_id", (F.col("winner_id") == a).cast("int").alias("a_won")
    )


def _h2h():
    return [
        F.count("*").alias("n"),
        F.sum("a_won").cast("long").alias("wins_a"),
        F.sum(1 - F.col("a_won")).cast("long").alias("wins_b"),
        F.max("match_day").alias("last_day"),
        F.round(F.avg("a_won") * 100, 4).alias("pct_a"),
    ]


def h2h_matches(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def h2h_overall(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("a", "b").agg(*_h2h())


def h2h_surface(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).filter("surface is not null").groupBy("a", "b", "surface").agg(*_h2h())


def h2h_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Overall and per surface in one pass."""
    rows = _pairs(spark, d).filter("surface is not null")
    out = rows.groupingSets([["a", "b", "surface"], ["a", "b"]], "a", "b", "surface").agg(*_h2h())
    return out.withColumn("surface", F.coalesce("surface", F.lit("ALL")))


def h2h_oriented(spark: SparkSession, d: str) -> DataFrame:
    """Head to head as asked for by the training rows: wins swapped where the order differs."""
    asked = table(spark, d, "training_matches").select("match_id", "player_a_id", "player_b_id")
    h = h2h_overall(spark, d)
    swap = F.col("player_a_id") > F.col("player_b_id")
    return asked.join(h, (F.least("player_a_id", "player_b_id") == h.a) & (F.greatest("player_a_id", "player_b_id") == h.b)).select(
        "match_id", "n", F.when(swap, F.col("wins_b")).otherwise(F.col("wins_a")).alias("wins_a"), F.when(swap, F.col("wins_a")).otherwise(F.col("wins_b")).alias("wins_b")
    )


_SIZES = (5, 10, 20, 50)
_PIT = ("won_match", "ace", "svpt", "first_in", "first_won")


def _pit(n: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = player_matches(spark, d).filter("surface is not null").select("row_id", "player_id", "surface", "match_day", *_PIT)
        out = before_date_last_n(rows, ["player_id", "surface"], "match_day", "row_id", _PIT, (n,))
        return out.select("row_id", "history", *[F.col(f"{m}_last{n}").cast("long").alias(f"{m}_last") for m in _PIT])

    run.__doc__ = f"Sums over the {n} most recent matches of an earlier date."
    return run


def _pit_sql(n: int) -> str:
    sums = ", ".join(f"CAST(sum(coalesce(h.{m}, 0)) AS BIGINT) AS {m}_last" for m in _PIT)
    return f"""WITH {PM}, r AS (SELECT row_id, player_id, surface, match_day, {', '.join(_PIT)},
 row_number() OVER (PARTITION BY player_id, surface ORDER BY match_day, row_id) AS k, rank() OVER (PARTITION BY player_id, surface ORDER BY match_day) - 1 AS history FROM pm WHERE surface IS NOT NULL)
SELECT r.row_id, r.history, {sums} FROM r LEFT JOIN r h ON h.player_id = r.player_id AND h.surface = r.surface AND h.k <= r.history AND h.k > r.history - {n} GROUP BY r.row_id, r.history"""


def _with_null_sums(sql: str) -> str:
    for m in _PIT:
        sql = sql.replace(f"CAST(sum(coalesce(h.{m}, 0)) AS BIGINT)", f"CAST(sum(CASE WHEN h.k IS NOT NULL THEN coalesce(h.{m}, 0) END) AS BIGINT)")
    return sql


_LATEST = ["match_day", "tourney_id", "match_num", "winner_id", "loser_id"]


def _long(spark: SparkSession, d: str) -> DataFrame:
    return winner_loser_rows(matches(spark, d), ["row_id", "match_day", "surface", "tourney_level", "tourney_id", "match_num", "winner_id", "loser_id"])


def long_form(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select("row_id", "match_day", "surface", "player_id", "opponent_id", "won")


def inactivity_days(spark: SparkSession, d: str) -> DataFrame:
    """Days since the player's last match overall and on the surface; -1 for the first."""
    rows = _long(spark, d)
    return rows.select(
        "row_id", "player_id",
        days_since_last(rows, ["player_id"], "match_day", _LATEST).alias("days"),
        F.when(F.col("surface").isNotNull(), days_since_last(rows, ["player_id", "surface"], "match_day", _LATEST)).alias("surface_days"),
    )


def experience_count(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select("row_id", "player_id", rows_before(["player_id"], _LATEST).alias("played"))


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    """Ids, idle days and K per match in a total order."""
    rows = _long(spark, d)
    days = rows.select(
        *[c for c in rows.columns], days_since_last(rows, ["player_id"], "match_day", _LATEST).alias("days"),
        days_since_last(rows, ["player_id", "surface"], "match_day", _LATEST).alias("sdays"),
    )
    side = lambda won, c: F.max(F.when(F.col("won") == won, F.col(c)))
    g = days.groupBy("row_id", "match_day", "surface", "tourney_level", "tourney_id", "match_num", "winner_id", "loser_id").agg(
        side(1, "days").alias("wd"), side(0, "days").alias("ld"), side(1, "sdays").alias("wsd"), side(0, "sdays").alias("lsd")
    )
    return g.withColumn("k", k_factor(F.col("tourney_level"), F.greatest("wd", "ld")))


def k_factors(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d).select("row_id", "wd", "ld", "k")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """The schedule with a sequence number, numbered by day in two levels."""
    s = _schedule(spark, d)
    sizes = s.groupBy("match_day").agg(F.count("*").alias("size"))
    # One row per day: bounded by the calendar.
    base = sizes.withColumn("base", F.sum("size").over(Window.orderBy("match_day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("size")
    inside = F.row_number().over(Window.partitionBy("match_day").orderBy(*_LATEST[1:]))
    return s.withColumn("i", inside).join(base, "match_day").withColumn("seq", (F.col("base") + F.col("i")).cast("long"))


def _overall(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return elo_fold(s.select(F.lit("all").alias("scope"), "seq", F.col("winner_id").alias("w"), F.col("loser_id").alias("l"), "wd", "ld", "k"), TAU_OVERALL)


def _by_surface(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    days = (F.col("wsd").alias("wd"), F.col("lsd").alias("ld"))
    return elo_fold(s.filter("surface is not null").select(F.col("surface").alias("scope"), "seq", F.col("winner_id").alias("w"), F.col("loser_id").alias("l"), *days, "k"), TAU_SURFACE)


def elo_overall(spark: SparkSession, d: str) -> DataFrame:
    """Overall ratings before each match."""
    s = cut_lineage(_ordered(spark, d))
    games, _ = _overall(s)
    return s.select("row_id", "seq").join(games, "seq").select("row_id", F.round("w_before", 6).alias("winner_elo"), F.round("l_before", 6).alias("loser_elo"))


def elo_surface(spark: SparkSession, d: str) -> DataFrame:
    """Ratings per surface before each match; an unknown surface has no state."""
    s = cut_lineage(_ordered(spark, d))
    games, _ = _by_surface(s)
    return s.select("row_id", "seq").join(games, "seq").select("row_id", F.round("w_before", 6).alias("winner_elo"), F.round("l_before", 6).alias("loser_elo"))


def elo_final(spark: SparkSession, d: str) -> DataFrame:
    """Ratings after the last match."""
    _, final = _overall(cut_lineage(_ordered(spark, d)))
    return final.select(F.col("item").alias("player_id"), F.round("rating", 6).alias("elo"))


def rating_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The state of both players before each match: ratings with and without decay, idle days and
    matches played, overall and on the surface; on an unknown surface the base rating."""
    rows = _long(spark, d)
    on_surface = ["player_id", "surface"]
    counts = rows.select("row_id", "won", rows_before(["player_id"], _LATEST).alias("played"), F.when(F.col("surface").isNotNull(), rows_before(on_surface, _LATEST)).otherwise(0).alias("splayed"))
    side = lambda won, c: F.max(F.when(F.col("won") == won, F.col(c)))
    counts = counts.groupBy("row_id").agg(side(1, "played").alias("wn"), side(0, "played").alias("ln"), side(1, "splayed").alias("wsn"), side(0, "splayed").alias("lsn"))
    s = cut_lineage(_ordered(spark, d))
    o, f = _overall(s)[0], _by_surface(s)[0]
    o = o.select("seq", *[F.col(c).alias(f"o_{c}") for c in ("w_before", "l_before", "w_stored", "l_stored")])
    f = f.select("seq", *[F.col(c).alias(f"f_{c}") for c in ("w_before", "l_before", "w_stored", "l_stored")])
    out = s.join(counts, "row_id").join(o, "seq").join(f, "seq", "left")
    known = F.col("surface").isNotNull()
    based = lambda c: F.coalesce(F.round(c, 6), F.lit(BASE_RATING))
    each = []
    for who, w in (("winner", "w"), ("loser", "l")):
        each += [
            F.round(f"o_{w}_before", 6).alias(f"{who}_elo_before"), F.round(f"o_{w}_stored", 6).alias(f"{who}_stored_elo"),
            based(f"f_{w}_before").alias(f"{who}_surface_elo_before"), based(f"f_{w}_stored").alias(f"{who}_surface_stored_elo"),
            (F.col(f"{w}d") == -1).cast("int").alias(f"{who}_is_new_player"), F.col(f"{w}d").alias(f"{who}_days_inactive"),
            F.when(known, F.col(f"{w}sd")).otherwise(-1).alias(f"{who}_surface_days_inactive"), F.col(f"{w}n").alias(f"{who}_matches_played"), F.col(f"{w}sn").alias(f"{who}_surface_matches_played"),
        ]
    return out.select("row_id", F.col("match_day").alias("match_date"), "surface", F.col("k").alias("k_factor"), "winner_id", "loser_id", *each)


def ratings_long(spark: SparkSession, d: str) -> DataFrame:
    side = lambda w: F.struct(
        F.col(f"{w}_id").alias("player_id"), F.col(f"{w}_elo_before").alias("elo"), F.col(f"{w}_surface_elo_before").alias("surface_elo"), F.col(f"{w}_matches_played").alias("played")
    )
    return table(spark, d, "player_elo_history").select("history_id", "match_date", "surface", F.explode(F.array(side("winner"), side("loser"))).alias("s")).select("history_id", "match_date", "surface", "s.*")


def _state(keys: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = ratings_long(spark, d).filter(" and ".join(f"{k} is not null" for k in keys))
        latest = F.max_by(F.struct("history_id", "match_date", "elo", "surface_elo", "played"), F.struct("match_date", "history_id"))
        return rows.groupBy(*keys).agg(latest.alias("s")).select(*keys, "s.*")

    return run


player_state_latest = _state(["player_id"])
surface_state_latest = _state(["player_id", "surface"])


def player_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One name per player id: the one of the latest delivery."""
    rows = table(spark, d, "analytics_player_matches").filter("player_id is not null and player is not null")
    return rows.groupBy("player_id").agg(F.max_by("player", F.struct("loaded_at", "row_id")).alias("name"), F.count("*").alias("n"))


def edge_table(spark: SparkSession, d: str) -> DataFrame:
    """Metric-by-metric comparison of the two players of each training row, unpivoted."""
    names = ("win_pct", "first_in_pct", "first_won_pct", "second_won_pct", "bp_saved_pct", "return_points_won_pct", "tb_won_pct")
    s = player_matches(spark, d).groupBy("player_id").agg(*suite()).select("player_id", *ratios()).select("player_id", *names)
    a = s.select(F.col("player_id").alias("player_a_id"), F.struct(*names).alias("a"))
    b = s.select(F.col("player_id").alias("player_b_id"), F.struct(*names).alias("b"))
    rows = table(spark, d, "training_matches").select("match_id", "player_a_id", "player_b_id").join(a, "player_a_id").join(b, "player_b_id")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"a.{n}").alias("va"), F.col(f"b.{n}").alias("vb")) for n in names]))
    diff = F.round(F.col("va") - F.col("vb"), 2)
    return rows.select("match_id", each.alias("x")).select("match_id", "x.*").filter("va is not null and vb is not null").select(
        "match_id", "metric", diff.alias("diff"), F.abs(diff).alias("abs_edge"), F.when(diff > 0, "A").when(diff < 0, "B").otherwise("TIE").alias("leader")
    )


QUERIES = {
    f.__name__: f
    for f in (
        form_last10, form_top, rolling_metrics, signal_labels, prediction_score, surface_metrics, player_metrics_windows, own_latest_window,
        coverage_by_year, h2h_matches, h2h_overall, h2h_surface, h2h_rollup, h2h_oriented, long_form, inactivity_days, experience_count, k_factors,
        elo_overall, elo_surface, elo_final, rating_snapshot, player_lookup, edge_table,
    )
}
QUERIES |= {f"pit_last_{n}": _pit(n) for n in _SIZES}
QUERIES |= {"player_state_latest": player_state_latest, "surface_state_latest": surface_state_latest}

_L10 = f"WITH {PM}, l10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, surface ORDER BY match_day DESC, row_id DESC) AS rn FROM pm WHERE surface IS NOT NULL) WHERE rn <= 10)"
_FORM = _L10 + f""", s AS (SELECT player_id, surface, {SUITE_SQL} FROM l10 GROUP BY 1, 2), q AS (SELECT player_id, surface, matches, {RATIOS_SQL} FROM s),
form AS (SELECT player_id, surface, matches, win_pct, first_won_pct, second_won_pct, CASE WHEN win_pct >= 75 THEN 'HIGH' WHEN win_pct >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS form,
 round(0.5::DOUBLE*win_pct + 0.3::DOUBLE*coalesce(first_won_pct,0) + 0.2::DOUBLE*coalesce(second_won_pct,0), 4) AS score FROM q WHERE matches >= 3)"""
_ROLL = _L10 + ", roll AS (SELECT player_id, surface, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in ("won_match", "minutes", "ace", "df", "first_in", "first_won", "second_won", "bp_saved")) + " FROM l10 GROUP BY 1, 2)"
_PAIRS = f"WITH {MATCHES}, pairs AS (SELECT least(winner_id, loser_id) AS a, greatest(winner_id, loser_id) AS b, surface, match_day, row_id, CAST(winner_id = least(winner_id, loser_id) AS INTEGER) AS a_won FROM matches)"
_H2H = "count(*) AS n, CAST(sum(a_won) AS BIGINT) AS wins_a, CAST(sum(1-a_won) AS BIGINT) AS wins_b, max(match_day) AS last_day, round(avg(a_won)*100, 4) AS pct_a"
_LONG = f"WITH {MATCHES}, lf AS (SELECT *, winner_id AS player_id, loser_id AS opponent_id, 1 AS won FROM matches UNION ALL SELECT *, loser_id, winner_id, 0 FROM matches)"
_ORD = "match_day, tourney_id, match_num, winner_id, loser_id"
_RL = """rl AS (SELECT history_id, match_date, surface, winner_id AS player_id, winner_elo_before AS elo, winner_surface_elo_before AS surface_elo, winner_matches_played AS played FROM player_elo_history
UNION ALL SELECT history_id, match_date, surface, loser_id, loser_elo_before, loser_surface_elo_before, loser_matches_played FROM player_elo_history)"""
_METRIC7 = ("win_pct", "first_in_pct", "first_won_pct", "second_won_pct", "bp_saved_pct", "return_points_won_pct", "tb_won_pct")

ORACLES = {
    "form_last10": _FORM + " SELECT * FROM form",
    "form_top": _FORM + " SELECT * FROM form ORDER BY score DESC NULLS LAST, player_id, surface LIMIT 20",
    "rolling_metrics": _ROLL + " SELECT * FROM roll",
    "signal_labels": _ROLL + """ SELECT player_id, surface, CASE WHEN mean_won_match*100 >= 75 THEN 'HIGH' WHEN mean_won_match*100 >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS form,
 CASE WHEN mean_minutes >= 150 THEN 'HIGH' WHEN mean_minutes >= 110 THEN 'MEDIUM' ELSE 'LOW' END AS fatigue,
 CASE WHEN mean_second_won < 45 THEN 'HIGH' WHEN mean_second_won < 52 THEN 'MEDIUM' ELSE 'LOW' END AS second_serve_risk,
 CASE WHEN mean_first_in >= 70 THEN 'HIGH' WHEN mean_first_in >= 65 THEN 'MEDIUM' ELSE 'LOW' END AS serve FROM roll""",
    "prediction_score": f"WITH {PM}, s AS (SELECT player_id, surface, {SUITE_SQL} FROM pm WHERE surface IS NOT NULL GROUP BY 1, 2), q AS (SELECT player_id, surface, {RATIOS_SQL} FROM s) SELECT player_id, surface, round(0.5::DOUBLE*win_pct + 0.2::DOUBLE*first_won_pct + 0.15::DOUBLE*second_won_pct + 0.15::DOUBLE*bp_saved_pct, 4) AS prediction_score FROM q",
    "surface_metrics": f"WITH {PM}, s AS (SELECT player_id, surface, {SUITE_SQL} FROM pm WHERE surface IS NOT NULL GROUP BY 1, 2) SELECT player_id, surface, matches, wins, {RATIOS_SQL} FROM s",
    "player_metrics_windows": f"""WITH {PM}, ok AS (SELECT *, max(match_day) OVER () AS newest FROM pm WHERE {PLAUSIBLE_SQL}),
g AS ({' UNION ALL '.join(f"SELECT *, '{k}' AS level_group FROM ok WHERE tourney_level IN {v if len(v) > 1 else '(' + repr(v[0]) + ')'}" for k, v in GROUPS.items())}),
w AS (SELECT *, 'CAREER' AS span FROM g UNION ALL SELECT *, '3M' FROM g WHERE match_day >= newest - INTERVAL 3 MONTH UNION ALL SELECT *, '6M' FROM g WHERE match_day >= newest - INTERVAL 6 MONTH),
s AS (SELECT player_id, level_group, span, {SUITE_SQL} FROM w GROUP BY 1, 2, 3) SELECT player_id, level_group, span, matches, wins, {FULL_SQL} FROM s WHERE matches >= 3""",
    "own_latest_window": f"WITH {PM}, x AS (SELECT *, max(match_day) OVER (PARTITION BY player_id) AS newest FROM pm) SELECT player_id, count(*) AS matches, CAST(sum(won_match) AS BIGINT) AS wins FROM x WHERE match_day >= newest - INTERVAL 3 MONTH GROUP BY 1",
    "coverage_by_year": f"WITH {PM} SELECT CAST(year(match_day) AS BIGINT) AS year, count(*) AS n, " + ", ".join(f"round(count({c})/count(*)*100, 4) AS {c}_pct" for c in ("ace", "svpt", "minutes", "bp_saved", "surface")) + " FROM pm GROUP BY 1",
    "h2h_matches": _PAIRS + " SELECT * FROM pairs",
    "h2h_overall": _PAIRS + f" SELECT a, b, {_H2H} FROM pairs GROUP BY a, b",
    "h2h_surface": _PAIRS + f" SELECT a, b, surface, {_H2H} FROM pairs WHERE surface IS NOT NULL GROUP BY a, b, surface",
    "h2h_rollup": _PAIRS + f" SELECT a, b, coalesce(surface, 'ALL') AS surface, {_H2H} FROM pairs WHERE surface IS NOT NULL GROUP BY GROUPING SETS ((a, b, surface), (a, b))",
    "h2h_oriented": _PAIRS + f", h AS (SELECT a, b, {_H2H} FROM pairs GROUP BY a, b) SELECT match_id, n, CASE WHEN player_a_id > player_b_id THEN wins_b ELSE wins_a END AS wins_a, CASE WHEN player_a_id > player_b_id THEN wins_a ELSE wins_b END AS wins_b FROM training_matches t JOIN h ON h.a = least(player_a_id, player_b_id) AND h.b = greatest(player_a_id, player_b_id)",
    "long_form": _LONG + " SELECT row_id, match_day, surface, player_id, opponent_id, won FROM lf",
    "inactivity_days": _LONG + f""" SELECT row_id, player_id, CAST(coalesce(date_diff('day', lag(match_day) OVER (PARTITION BY player_id ORDER BY {_ORD}), match_day), -1) AS INTEGER) AS days,
 CASE WHEN surface IS NOT NULL THEN CAST(coalesce(date_diff('day', lag(match_day) OVER (PARTITION BY player_id, surface ORDER BY {_ORD}), match_day), -1) AS INTEGER) END AS surface_days FROM lf""",
    "experience_count": _LONG + f" SELECT row_id, player_id, row_number() OVER (PARTITION BY player_id ORDER BY {_ORD}) - 1 AS played FROM lf",
    "k_factors": _LONG + f""", x AS (SELECT row_id, tourney_level, won, CAST(coalesce(date_diff('day', lag(match_day) OVER (PARTITION BY player_id ORDER BY {_ORD}), match_day), -1) AS INTEGER) AS days FROM lf),
y AS (SELECT row_id, any_value(tourney_level) AS lv, max(CASE WHEN won = 1 THEN days END) AS wd, max(CASE WHEN won = 0 THEN days END) AS ld FROM x GROUP BY row_id)
SELECT row_id, wd, ld, (CASE lv WHEN 'G' THEN 40.0 WHEN 'M' THEN 32.0 WHEN '500' THEN 28.0 ELSE 24.0 END * CASE WHEN greatest(wd, ld) > 180 THEN 2.0 WHEN greatest(wd, ld) > 70 THEN 1.5 ELSE 1.0 END)::DOUBLE AS k FROM y""",
    "player_lookup": "SELECT player_id, arg_max(player, (loaded_at, row_id)) AS name, count(*) AS n FROM analytics_player_matches WHERE player_id IS NOT NULL AND player IS NOT NULL GROUP BY 1",
    "player_state_latest": f"WITH {_RL} SELECT player_id, history_id, match_date, elo, surface_elo, played FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, history_id DESC) AS rn FROM rl WHERE player_id IS NOT NULL) WHERE rn = 1",
    "surface_state_latest": f"WITH {_RL} SELECT player_id, surface, history_id, match_date, elo, surface_elo, played FROM (SELECT *, row_number() OVER (PARTITION BY player_id, surface ORDER BY match_date DESC, history_id DESC) AS rn FROM rl WHERE player_id IS NOT NULL AND surface IS NOT NULL) WHERE rn = 1",
    "edge_table": f"""WITH {PM}, s AS (SELECT player_id, {SUITE_SQL} FROM pm GROUP BY 1), q AS (SELECT player_id, {RATIOS_SQL} FROM s),
u AS ({' UNION ALL '.join(f"SELECT player_id, '{n}' AS metric, {n} AS v FROM q" for n in _METRIC7)}),
x AS (SELECT match_id, a.metric, round(a.v - b.v, 2) AS diff FROM training_matches t JOIN u a ON a.player_id = t.player_a_id JOIN u b ON b.player_id = t.player_b_id AND a.metric = b.metric WHERE a.v IS NOT NULL AND b.v IS NOT NULL)
SELECT match_id, metric, diff, abs(diff) AS abs_edge, CASE WHEN diff > 0 THEN 'A' WHEN diff < 0 THEN 'B' ELSE 'TIE' END AS leader FROM x""",
}
ORACLES |= {f"pit_last_{n}": _with_null_sums(_pit_sql(n)) for n in _SIZES}


def _elo_sql(scope: str, tau: float, wd: str, ld: str, name: str = "") -> str:
    """Tables of the fold as a recursive query with the ratings in a list; ``name`` tells two folds apart."""
    return f"""ids{name} AS (SELECT scope, id, row_number() OVER (ORDER BY scope, id) AS i FROM (SELECT DISTINCT {scope} AS scope, unnest([winner_id, loser_id]) AS id FROM g WHERE {scope} IS NOT NULL)),
o{name} AS (SELECT row_number() OVER (ORDER BY {_ORD}) AS n, row_id, w.i AS w, l.i AS l, {wd} AS wd, {ld} AS ld, k
 FROM g JOIN ids{name} w ON w.scope = {scope} AND w.id = winner_id JOIN ids{name} l ON l.scope = {scope} AND l.id = loser_id),
f{name}(n, row_id, we, le, ws, ls, st) AS (
  SELECT 0::BIGINT, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, (SELECT list_transform(range(count(*)), lambda i: 1500.0::DOUBLE) FROM ids{name})
  UNION ALL
  SELECT n, row_id, we, le, ws, ls, list_transform(st, lambda v, i: CASE WHEN i = w THEN v + k*(1-e) WHEN i = l THEN v - k*(1-e) ELSE v END)
  FROM (SELECT *, 1/(1+pow(10.0, (le-we)/400.0)) AS e FROM (SELECT o.n, o.row_id, o.w, o.l, o.k, f.st, f.st[w] AS ws, f.st[l] AS ls,
    CASE WHEN wd <= 0 THEN f.st[w] ELSE 1500+(f.st[w]-1500)*exp(-wd/{tau}) END AS we, CASE WHEN ld <= 0 THEN f.st[l] ELSE 1500+(f.st[l]-1500)*exp(-ld/{tau}) END AS le
    FROM f{name} f JOIN o{name} o ON o.n = f.n + 1)))"""


_SCHEDULE = _LONG.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + f""", day AS (SELECT *, CAST(coalesce(date_diff('day', lag(match_day) OVER (PARTITION BY player_id ORDER BY {_ORD}), match_day), -1) AS INTEGER) AS days,
 CAST(coalesce(date_diff('day', lag(match_day) OVER (PARTITION BY player_id, surface ORDER BY {_ORD}), match_day), -1) AS INTEGER) AS sdays,
 row_number() OVER (PARTITION BY player_id ORDER BY {_ORD}) - 1 AS played, row_number() OVER (PARTITION BY player_id, surface ORDER BY {_ORD}) - 1 AS splayed FROM lf),
g0 AS (SELECT row_id, match_day, surface, tourney_level, tourney_id, match_num, winner_id, loser_id, max(CASE WHEN won = 1 THEN days END) AS wd, max(CASE WHEN won = 0 THEN days END) AS ld,
 max(CASE WHEN won = 1 THEN sdays END) AS wsd, max(CASE WHEN won = 0 THEN sdays END) AS lsd, max(CASE WHEN won = 1 THEN played END) AS wn, max(CASE WHEN won = 0 THEN played END) AS ln,
 max(CASE WHEN won = 1 THEN splayed END) AS wsn, max(CASE WHEN won = 0 THEN splayed END) AS lsn FROM day GROUP BY ALL),
g AS (SELECT *, (CASE tourney_level WHEN 'G' THEN 40.0 WHEN 'M' THEN 32.0 WHEN '500' THEN 28.0 ELSE 24.0 END * CASE WHEN greatest(wd, ld) > 180 THEN 2.0 WHEN greatest(wd, ld) > 70 THEN 1.5 ELSE 1.0 END)::DOUBLE AS k FROM g0),
"""
_OVERALL = _elo_sql("'all'", TAU_OVERALL, "g.wd", "g.ld")
_BEFORE = " SELECT row_id, round(we, 6) AS winner_elo, round(le, 6) AS loser_elo FROM f WHERE n > 0"
ORACLES["elo_overall"] = _SCHEDULE + _OVERALL + _BEFORE
ORACLES["elo_surface"] = _SCHEDULE + _elo_sql("surface", TAU_SURFACE, "wsd", "lsd") + _BEFORE
ORACLES["elo_final"] = _SCHEDULE + _OVERALL + " SELECT id AS player_id, round(st[i], 6) AS elo FROM ids, (SELECT st FROM f ORDER BY n DESC LIMIT 1)"


def _side_sql(who: str, w: str) -> str:
    return f"""round(a.{w}e, 6) AS {who}_elo_before, round(a.{w}s, 6) AS {who}_stored_elo, coalesce(round(b.{w}e, 6), 1500.0) AS {who}_surface_elo_before,
 coalesce(round(b.{w}s, 6), 1500.0) AS {who}_surface_stored_elo, CAST(g.{w}d = -1 AS INTEGER) AS {who}_is_new_player, g.{w}d AS {who}_days_inactive,
 CASE WHEN surface IS NULL THEN -1 ELSE {w}sd END AS {who}_surface_days_inactive, {w}n AS {who}_matches_played, CASE WHEN surface IS NULL THEN 0 ELSE {w}sn END AS {who}_surface_matches_played"""


ORACLES["rating_snapshot"] = (
    _SCHEDULE + _OVERALL + ", " + _elo_sql("surface", TAU_SURFACE, "wsd", "lsd", "2")
    + f" SELECT g.row_id, match_day AS match_date, surface, k AS k_factor, winner_id, loser_id, {_side_sql('winner', 'w')}, {_side_sql('loser', 'l')} FROM g JOIN f a ON a.row_id = g.row_id LEFT JOIN f2 b ON b.row_id = g.row_id"
)
