"""Queries of the smaller operators: columns by name, predicates, bucket sets, named formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.functions.buckets import cut, cut_sql, label
from rallygrid.functions.columns import drop_present, keep_present, numeric_columns, with_features
from rallygrid.functions.dates import date_int, date_label
from rallygrid.functions.formulas import half_even, half_even_sql
from rallygrid.functions.text import capitalised
from rallygrid.operators.ordering import digest_order, first_known, global_row_number, join_with_suffixes, stratified_split as split_by_class
from rallygrid.plans.base import BETS, PM, bets, player_matches
from rallygrid.plans.betting import _STATS_SQL, _stats, roi_by_year
from rallygrid.session import table

#: Edges of the bucket sets (fixed values): edges, and whether the lowest edge is in the first.
BUCKET_SETS = {
    "probability_fine": ("p_model", (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1), False),
    "probability_extreme": ("p_model", (0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1), True),
    "odds_wide": ("odds", (1, 1.5, 2, 3, 100), True),
    "odds_underdogs": ("odds", (1.5, 2, 3, 5, 100), False),
    "idle_six": ("delta_idle", (-1000, -30, -14, -7, 0, 30, 1000), False),
    "idle_eight": ("delta_idle", (-1000, -30, -14, -7, 0, 7, 14, 30, 1000), False),
    "abs_elo": ("abs_elo", (0, 50, 100, 150, 200, 9999), False),
}
KEPT = ("odds_id", "Date", "Winner", "Loser", "Court", "AvgW", "AvgL", "Comment")
DROPPED = ("PSW", "PSL", "B365W", "B365L", "Court")
MODEL_FEATURES = ("delta_rank", "delta_rank_points", "delta_elo", "delta_surface_elo")
#: Thresholds of the named strategy and of the display (fixed values).
ACTIVE_DAYS, SHOWN_EDGE = -14, 0.10


def _buckets(name: str):
    column, edges, lowest = BUCKET_SETS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = bets(spark, d).withColumn("abs_elo", F.abs("delta_elo")).withColumn("bucket", cut(F.col(column).cast("double"), edges, lowest))
        return rows.filter("bucket is not null").groupBy("bucket").agg(*_stats()).withColumn("label", label(F.col("bucket"), edges))

    run.__doc__ = f"Bets by bucket set {name}."
    return run


def keep_columns(spark: SparkSession, d: str) -> DataFrame:
    return keep_present(table(spark, d, "atp_odds"), KEPT)


def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return drop_present(table(spark, d, "atp_odds"), DROPPED)


def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    """Known values and mean of every numeric column, found from the schema."""
    t = table(spark, d, "training_matches")
    names = numeric_columns(t, without=("match_id",))
    s = t.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("known"), F.round(F.avg(c), 6).alias("mean")).alias(c) for c in names])
    return s.select(F.explode(F.array(*names)).alias("x")).select("x.*")


def model_vector(spark: SparkSession, d: str) -> DataFrame:
    """The features of a model; those the table lacks are null."""
    return with_features(table(spark, d, "training_matches"), MODEL_FEATURES, ["match_id"])


def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Quotes numbered from 0 by time, then id."""
    rows = table(spark, d, "atp_odds").select("odds_id", "Date")
    return global_row_number(rows, [F.col("Date").asc_nulls_first(), F.col("odds_id")], "seq").select("odds_id", "seq")


def other_levels(spark: SparkSession, d: str) -> DataFrame:
    """Rows of any level but C; an unknown level is not C."""
    return table(spark, d, "training_matches").filter(~F.col("tourney_level").eqNullSafe("C")).select("match_id", "tourney_level")


def close_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Bets with ratings less than 50 apart, by who was less idle."""
    side = F.when(F.col("delta_idle") < 0, "active").when(F.col("delta_idle") > 0, "idle").otherwise("even")
    return bets(spark, d).filter(F.abs("delta_elo") < 50).groupBy(side.alias("side")).agg(*_stats())


def known_activity(spark: SparkSession, d: str) -> DataFrame:
    """Recorded matches in which neither player is new (-1 stands for a first match), by bucket of
    the idle days between them."""
    edges = (-10000, -60, -30, -14, -7, 0, 7, 14, 30, 60, 10000)
    rows = table(spark, d, "player_elo_history").filter("winner_days_inactive >= 0 and loser_days_inactive >= 0")
    gap = (F.col("winner_days_inactive") - F.col("loser_days_inactive")).cast("double")
    return rows.groupBy(cut(gap, edges).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("mean_gap"))


def int_date_join(spark: SparkSession, d: str) -> DataFrame:
    """Training rows and ratings met on the date as an integer."""
    t = table(spark, d, "training_matches").select("match_id", "player_a_id", "player_b_id", date_int(F.to_date("match_date")).alias("day_int"))
    h = table(spark, d, "player_elo_history").select("history_id", F.col("winner_id").alias("player_a_id"), F.col("loser_id").alias("player_b_id"), date_int(F.col("match_date")).alias("day_int"))
    return t.join(h, ["player_a_id", "player_b_id", "day_int"]).select("match_id", "history_id", "day_int")


def suffixed_join(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' surface kept under suffixes."""
    t = table(spark, d, "training_matches").select("match_id", "player_a_id", "player_b_id", F.to_date("match_date").alias("day"), "surface")
    h = table(spark, d, "player_elo_history").select("history_id", F.col("winner_id").alias("player_a_id"), F.col("loser_id").alias("player_b_id"), F.col("match_date").alias("day"), "surface")
    return join_with_suffixes(t, h, ["player_a_id", "player_b_id", "day"]).select("match_id", "history_id", "surface_x", "surface_y")


def first_known_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Per pair the earliest known value of each price, though from different rows."""
    rows = table(spark, d, "atp_odds").select(F.lower(F.trim("pair_key")).alias("pair"), "Date", "odds_id", "AvgW", "AvgL", "PSW", "PSL")
    return first_known(rows.filter("pair is not null"), ["pair"], [F.col("Date").isNull(), F.col("Date"), F.col("odds_id")], ["AvgW", "AvgL", "PSW", "PSL"])


def roi_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Bets above the threshold by tournament level of the training row."""
    t = table(spark, d, "training_matches").filter("tourney_level is not null and match_date is not null")
    levels = t.groupBy(F.least("player_a_id", "player_b_id").alias("lo"), F.greatest("player_a_id", "player_b_id").alias("hi"), F.to_date("match_date").alias("match_date")).agg(F.max("tourney_level").alias("level"))
    rows = bets(spark, d).filter("edge > 0.05").withColumns({"lo": F.least("player", "opponent"), "hi": F.greatest("player", "opponent")})
    return rows.join(levels, ["lo", "hi", "match_date"]).groupBy("level").agg(*_stats())


def activity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Favourites and underdogs by how much less idle they were; exactly even belongs nowhere."""
    side = F.when(F.col("p_market") > 0.5, "favourite").when(F.col("p_market") < 0.5, "underdog")
    band = F.when(F.col("delta_idle") < -14, "much more active").when(F.col("delta_idle") < 0, "more active").when(F.col("delta_idle") > 0, "less active")
    return bets(spark, d).filter("edge > 0.05").withColumns({"side": side, "band": band}).filter("side is not null and band is not null").groupBy("side", "band").agg(*_stats())


_CORR = ("target", "delta_elo", "delta_surface_elo", "delta_idle", "delta_surface_idle")


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlations of all pairs of columns in one aggregate, a row per pair."""
    pairs = [(a, b) for a in _CORR for b in _CORR]
    s = bets(spark, d).agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(f"{a}__{b}", 6).alias("r")) for a, b in pairs])
    return s.select(F.explode(each).alias("p")).select("p.*")


def mean_of_years(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the yearly figures: every year counts alike."""
    return roi_by_year(spark, d).agg(F.count("*").alias("years"), F.round(F.avg("roi"), 5).alias("mean_roi"), F.round(F.avg("hit"), 5).alias("mean_hit"))


def bottom_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The twenty lowest ratings (a bottom-k report)."""
    rows = table(spark, d, "player_elo_history").filter("loser_elo_before is not null")
    return rows.orderBy(F.col("loser_elo_before").asc(), "history_id").limit(20).select("history_id", "loser_id", F.col("loser_elo_before").alias("elo"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample of 100 rows: a sampling operator, its size is the feature."""
    return table(spark, d, "training_matches").orderBy(digest_order("match_id"), "match_id").limit(100).select("match_id", "target")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Of every class exactly four fifths marked train, the others test."""
    rows = table(spark, d, "training_matches").filter("target is not null").select("match_id", "target")
    return split_by_class(rows, "target", "match_id")


def even_money(spark: SparkSession, d: str) -> DataFrame:
    """(wins - losses) / n of the sides the model prefers, by year."""
    won = F.sum(F.when(F.col("target") == 1, 1).otherwise(-1))
    return bets(spark, d).filter("p_model >= 0.5").groupBy(F.year("match_date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(won / F.count("*"), 6).alias("even_roi"))


def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    """.5 win + .3 first serve + .2 second serve; unknown terms but the first count nothing."""
    s = player_matches(spark, d).filter("surface is not null").groupBy("player_id", "surface").agg(
        (F.avg("won_match") * 100).alias("win"), F.avg("first_won").alias("first"), F.avg("second_won").alias("second")
    )
    zero = F.lit(0.0)
    score = 0.5 * F.col("win") + 0.3 * F.coalesce("first", zero) + 0.2 * F.coalesce("second", zero)
    return s.select("player_id", "surface", F.round(score, 4).alias("confidence_score"))


def breaks_converted(spark: SparkSession, d: str) -> DataFrame:
    """Break points faced less those saved by the opponent, from the opponent's counts."""
    return player_matches(spark, d).select("row_id", (F.col("opp_bp_faced") - F.col("opp_bp_saved")).alias("breaks"))


def strategy_production(spark: SparkSession, d: str) -> DataFrame:
    """The served form of the strategy: probability instead of edge."""
    zone = (F.col("p_model") >= 0.5) & (F.col("delta_elo") < 0) & (F.col("delta_surface_idle") < ACTIVE_DAYS)
    return bets(spark, d).groupBy(F.coalesce(zone, F.lit(False)).alias("chosen")).agg(*_stats())


def shown_bets(spark: SparkSession, d: str) -> DataFrame:
    """Bets above the threshold of the display."""
    return bets(spark, d).filter(F.col("edge") > SHOWN_EDGE).select("history_id", "player", "target", half_even(F.col("edge"), 4).alias("edge"))


def event_history(spark: SparkSession, d: str) -> DataFrame:
    """Event names capitalised, dates written out."""
    return player_matches(spark, d).select("row_id", capitalised(F.col("tourney_name")).alias("event"), date_label(F.col("match_day")).alias("day"))


_ALL = (
    keep_columns, drop_columns, numeric_profile, model_vector, surrogate_ids, other_levels, close_ratings, known_activity, int_date_join, suffixed_join, first_known_quotes,
    roi_by_level, activity_bands, correlation_matrix, mean_of_years, bottom_ratings, hash_sample, stratified_split, even_money, confidence_score, breaks_converted,
    strategy_production, shown_bets, event_history,
)
QUERIES = {f.__name__: f for f in _ALL} | {f"buckets_{n}": _buckets(n) for n in BUCKET_SETS}


def _bucket_sql(name: str) -> str:
    column, edges, lowest = BUCKET_SETS[name]
    arms = " ".join(f"WHEN {i} THEN '{lo:g}:{hi:g}'" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return f"WITH {BETS}, x AS (SELECT *, abs(delta_elo) AS abs_elo FROM bets), y AS (SELECT *, {cut_sql(column, edges, lowest)} AS bucket FROM x) SELECT bucket, CASE bucket {arms} END AS label, {_STATS_SQL} FROM y WHERE bucket IS NOT NULL GROUP BY bucket"


_MD5 = "md5(concat_ws(':', CAST(match_id AS VARCHAR), '42'))"
_FIRST = ", ".join(f"arg_min({c}, (\"Date\" IS NULL, \"Date\", odds_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("AvgW", "AvgL", "PSW", "PSL"))
ORACLES = {
    "keep_columns": 'SELECT odds_id, "Date", "Winner", "Loser", AvgW, AvgL FROM atp_odds',
    "drop_columns": "SELECT * EXCLUDE (PSW, PSL, B365W, B365L) FROM atp_odds",
    "numeric_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS known, round(avg({c}), 6) AS mean FROM training_matches" for c in ("target", "delta_rank", "delta_rank_points")),
    "model_vector": "SELECT match_id, delta_rank, delta_rank_points, CAST(NULL AS DOUBLE) AS delta_elo, CAST(NULL AS DOUBLE) AS delta_surface_elo FROM training_matches",
    "surrogate_ids": 'SELECT odds_id, row_number() OVER (ORDER BY "Date" NULLS FIRST, odds_id) - 1 AS seq FROM atp_odds',
    "other_levels": "SELECT match_id, tourney_level FROM training_matches WHERE tourney_level IS DISTINCT FROM 'C'",
    "close_ratings": f"WITH {BETS} SELECT CASE WHEN delta_idle < 0 THEN 'active' WHEN delta_idle > 0 THEN 'idle' ELSE 'even' END AS side, {_STATS_SQL} FROM bets WHERE abs(delta_elo) < 50 GROUP BY 1",
    "known_activity": f"WITH x AS (SELECT winner_days_inactive - loser_days_inactive AS gap FROM player_elo_history WHERE winner_days_inactive >= 0 AND loser_days_inactive >= 0) SELECT {cut_sql('gap', (-10000, -60, -30, -14, -7, 0, 7, 14, 30, 60, 10000))} AS bucket, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM x GROUP BY 1",
    "int_date_join": "SELECT match_id, history_id, CAST(strftime(h.match_date, '%Y%m%d') AS INTEGER) AS day_int FROM training_matches t JOIN player_elo_history h ON h.winner_id = player_a_id AND h.loser_id = player_b_id AND h.match_date = CAST(t.match_date AS DATE)",
    "suffixed_join": "SELECT match_id, history_id, t.surface AS surface_x, h.surface AS surface_y FROM training_matches t JOIN player_elo_history h ON h.winner_id = player_a_id AND h.loser_id = player_b_id AND h.match_date = CAST(t.match_date AS DATE)",
    "first_known_quotes": f"SELECT lower(trim(pair_key)) AS pair, {_FIRST} FROM atp_odds WHERE pair_key IS NOT NULL GROUP BY 1",
    "roi_by_level": f"WITH {BETS}, lv AS (SELECT least(player_a_id, player_b_id) AS lo, greatest(player_a_id, player_b_id) AS hi, CAST(match_date AS DATE) AS dt, max(tourney_level) AS level FROM training_matches WHERE tourney_level IS NOT NULL AND match_date IS NOT NULL GROUP BY 1, 2, 3) SELECT level, {_STATS_SQL} FROM bets JOIN lv ON lo = least(player, opponent) AND hi = greatest(player, opponent) AND dt = match_date WHERE edge > 0.05 GROUP BY 1",
    "activity_bands": f"WITH {BETS}, x AS (SELECT *, CASE WHEN p_market > 0.5 THEN 'favourite' WHEN p_market < 0.5 THEN 'underdog' END AS side, CASE WHEN delta_idle < -14 THEN 'much more active' WHEN delta_idle < 0 THEN 'more active' WHEN delta_idle > 0 THEN 'less active' END AS band FROM bets WHERE edge > 0.05) SELECT side, band, {_STATS_SQL} FROM x WHERE side IS NOT NULL AND band IS NOT NULL GROUP BY 1, 2",
    "correlation_matrix": f"WITH {BETS} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM bets" for a in _CORR for b in _CORR),
    "mean_of_years": f"WITH {BETS}, y AS (SELECT year(match_date) AS year, round(avg(profit), 6) AS roi, round(avg(target), 6) AS hit FROM bets WHERE edge > 0.05 GROUP BY 1) SELECT count(*) AS years, round(avg(roi), 5) AS mean_roi, round(avg(hit), 5) AS mean_hit FROM y",
    "bottom_ratings": "SELECT history_id, loser_id, loser_elo_before AS elo FROM player_elo_history WHERE loser_elo_before IS NOT NULL ORDER BY elo, history_id LIMIT 20",
    "hash_sample": f"SELECT match_id, target FROM training_matches ORDER BY {_MD5}, match_id LIMIT 100",
    "stratified_split": f"SELECT match_id, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY {_MD5}, match_id) <= floor(count(*) OVER (PARTITION BY target) * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS part FROM training_matches WHERE target IS NOT NULL",
    "even_money": f"WITH {BETS} SELECT CAST(year(match_date) AS BIGINT) AS year, count(*) AS n, round((count(*) FILTER (target = 1) - count(*) FILTER (target <> 1)) / count(*), 6) AS even_roi FROM bets WHERE p_model >= 0.5 GROUP BY 1",
    "confidence_score": f"WITH {PM} SELECT player_id, surface, round(0.5::DOUBLE * (avg(won_match) * 100) + 0.3::DOUBLE * coalesce(avg(first_won), 0) + 0.2::DOUBLE * coalesce(avg(second_won), 0), 4) AS confidence_score FROM pm WHERE surface IS NOT NULL GROUP BY 1, 2",
    "breaks_converted": f"WITH {PM} SELECT row_id, opp_bp_faced - opp_bp_saved AS breaks FROM pm",
    "strategy_production": f"WITH {BETS} SELECT coalesce(p_model >= 0.5 AND delta_elo < 0 AND delta_surface_idle < -14, false) AS chosen, {_STATS_SQL} FROM bets GROUP BY 1",
    "shown_bets": f"WITH {BETS} SELECT history_id, player, target, {half_even_sql('edge', 4)} AS edge FROM bets WHERE edge > 0.1::DOUBLE",
    "event_history": f"WITH {PM} SELECT row_id, upper(left(tourney_name, 1)) || lower(substring(tourney_name, 2)) AS event, strftime(match_day, '%d %b %Y') AS day FROM pm",
} | {f"buckets_{n}": _bucket_sql(n) for n in BUCKET_SETS}
