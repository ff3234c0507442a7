"""Lookups, comparisons and predictions: single questions are filters pushed into the batch frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.functions.columns import with_features
from rallygrid.functions.formulas import confidence_tier, half_even
from rallygrid.functions.metrics import full_suite, suite
from rallygrid.functions.text import canonical_name
from rallygrid.ml import score
from rallygrid.operators.joins import backward_asof
from rallygrid.operators.windows import last_n
from rallygrid.plans.base import matches, player_matches
from rallygrid.plans.players import ratings_long, player_lookup

#: Windows of the metrics, and the metrics of the edge table (fixed values).
WINDOWS = ("LAST_10_MATCHES", "LAST_3_MONTHS", "LAST_6_MONTHS", "CAREER")
EDGE_METRICS = ("win_pct", "first_in_pct", "first_won_pct", "second_won_pct", "bp_saved_pct", "return_points_won_pct", "tb_won_pct")
#: Values of a prediction beside its probability, in order.
STATE = ("elo_a", "elo_b", "surface_elo_a", "surface_elo_b", "days_inactive_a", "days_inactive_b", "surface_days_inactive_a", "surface_days_inactive_b")
DELTAS = ("delta_elo", "delta_inactivity_days", "delta_surface_inactivity_days")


def get_player_id(spark: SparkSession, d: str, name: str) -> str | None:
    wanted = canonical_name(F.lit(name))
    row = player_lookup(spark, d).filter(canonical_name(F.col("name")) == wanted).orderBy("player_id").first()
    return row["player_id"] if row else None


def get_player_name(spark: SparkSession, d: str, player_id: str) -> str | None:
    row = player_lookup(spark, d).filter(F.col("player_id") == player_id).first()
    return row["name"] if row else None


def all_players(spark: SparkSession, d: str) -> DataFrame:
    return player_lookup(spark, d).select("player_id", "name").orderBy("name", "player_id")


def runtime_metrics(rows: DataFrame, levels: Sequence[str] | None = None) -> DataFrame:
    """``player_id, surface, span, matches, wins`` and all metrics, for every window of ``WINDOWS``.
    The months end at the player's own newest match on the surface among the given levels."""
    rows = rows.filter("player_id is not null and surface is not null")
    if levels is not None:
        rows = rows.filter(F.col("tourney_level").isin(*levels))
    keys = ["player_id", "surface"]
    newest = rows.groupBy(*keys).agg(F.max("match_day").alias("newest"))
    months = lambda n, name: F.when(F.col("match_day") >= F.add_months("newest", -n), name)
    spans = F.explode(F.array_compact(F.array(F.lit("CAREER"), months(3, "LAST_3_MONTHS"), months(6, "LAST_6_MONTHS"))))
    dated = rows.join(newest, keys).withColumn("span", spans).drop("newest")
    last = last_n(rows, keys, [F.col("match_day").desc(), F.col("row_id").desc()], 10).withColumn("span", F.lit("LAST_10_MATCHES"))
    return dated.unionByName(last).groupBy(*keys, "span").agg(*suite()).select(*keys, "span", "matches", "wins", *full_suite())


def build_player_metrics(spark: SparkSession, d: str, player_id: str, surface: str, levels: Sequence[str], window: str) -> dict | None:
    """All metrics of one player in one window; None without matches."""
    rows = player_matches(spark, d).filter((F.col("player_id") == player_id) & (F.col("surface") == surface))
    row = runtime_metrics(rows, levels).filter(F.col("span") == window).first()
    return row.asDict() if row else None


def compare(spark: SparkSession, d: str, a: str, b: str, surface: str, window: str = "CAREER") -> DataFrame:
    """The metric suite of both players, one row each."""
    rows = player_matches(spark, d).filter(F.col("player_id").isin(a, b) & (F.col("surface") == surface))
    return runtime_metrics(rows).filter(F.col("span") == window)


def compare_edges(spark: SparkSession, d: str, a: str, b: str, surface: str, window: str = "CAREER") -> DataFrame:
    """``metric, value_a, value_b, diff, abs_edge, leader``, largest edge first; unknown metrics left out."""
    both = compare(spark, d, a, b, surface, window)
    of = lambda p, m: F.max(F.when(F.col("player_id") == p, F.col(m)))
    one = both.agg(*[F.struct(F.lit(m).alias("metric"), of(a, m).alias("value_a"), of(b, m).alias("value_b")).alias(m) for m in EDGE_METRICS])
    rows = one.select(F.explode(F.array(*EDGE_METRICS)).alias("x")).select("x.*").filter("value_a is not null and value_b is not null")
    diff = half_even(F.col("value_a") - F.col("value_b"), 2)
    leader = F.when(F.col("diff") > 0, a).when(F.col("diff") < 0, b).otherwise("TIE")
    return rows.withColumn("diff", diff).withColumn("abs_edge", F.abs("diff")).withColumn("leader", leader).orderBy(F.col("abs_edge").desc(), "metric")


def head_to_head(spark: SparkSession, d: str, a: str, b: str, surface: str | None = None) -> DataFrame:
    """Matches of the pair in the asked orientation: n, wins of a, wins of b, last day."""
    pair = matches(spark, d).filter((F.least("winner_id", "loser_id") == min(a, b)) & (F.greatest("winner_id", "loser_id") == max(a, b)))
    if surface:
        pair = pair.filter(F.col("surface") == surface)
    won = (F.col("winner_id") == a).cast("long")
    return pair.agg(F.count("*").alias("n"), F.coalesce(F.sum(won), F.lit(0)).alias("wins_a"), F.coalesce(F.sum(1 - won), F.lit(0)).alias("wins_b"), F.max("match_day").alias("last_day"))


def analyze(spark: SparkSession, d: str, a: str, b: str, surface: str) -> dict:
    """Metrics of both players and their head to head, as records."""
    rows = {r["player_id"]: r.asDict() for r in compare(spark, d, a, b, surface).collect()}  # two rows
    return {"player_a": rows.get(a), "player_b": rows.get(b), "h2h": head_to_head(spark, d, a, b, surface).first().asDict()}


def match_features(events: DataFrame, ratings: DataFrame, historical: bool = False) -> DataFrame:
    """State and differences of both players of every event, in batch.

    ``events``: ``event_id`` (unique), ``player_a_id, player_b_id, surface, day``; ``ratings``:
    ``history_id, match_date, surface, player_id, elo, surface_elo``. Live: each player's latest state, and the
    latest on the surface, whatever the day. Historical: the latest at or before the day, idle days not
    below 0, an unknown surface state counting 0 days in the difference. Events with a player without
    any state are left out; an unknown surface state gives nulls."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"player_{s}_id").alias("player_id"))
    long = events.select("event_id", "day", "surface", F.explode(F.array(side("a"), side("b"))).alias("s")).select("event_id", "day", "surface", "s.*")
    if historical:
        known = backward_asof(long, ratings.select("player_id", F.col("match_date").alias("seen"), "history_id", "elo"), ["player_id"], "day", "seen", "history_id", ["elo"]).drop("history_id")
        on = ratings.select("player_id", "surface", F.col("match_date").alias("surface_seen"), "history_id", "surface_elo")
        known = backward_asof(known, on, ["player_id", "surface"], "day", "surface_seen", "history_id", ["surface_elo"])
    else:
        last = lambda keys, *c: ratings.filter(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max_by(F.struct("match_date", *c), F.struct("match_date", "history_id")).alias("x"))
        overall = last(["player_id"], "elo").select("player_id", F.col("x.match_date").alias("seen"), "x.elo")
        own = last(["player_id", "surface"], "surface_elo").select("player_id", "surface", F.col("x.match_date").alias("surface_seen"), "x.surface_elo")
        known = long.join(overall, "player_id", "left").join(own, ["player_id", "surface"], "left")
    days = lambda c: F.greatest(F.lit(0), F.date_diff("day", c)) if historical else F.date_diff("day", c)
    of = lambda s, c: F.max(F.when(F.col("side") == s, c))
    idle, surface_idle = days("seen"), F.when(F.col("surface_seen").isNotNull(), days("surface_seen"))
    values = {"elo": F.col("elo"), "surface_elo": F.col("surface_elo"), "days_inactive": F.when(F.col("seen").isNotNull(), idle), "surface_days_inactive": surface_idle}
    wide = known.groupBy("event_id").agg(*[of(s, v).alias(f"{n}_{s}") for n, v in values.items() for s in "ab"], F.count("seen").alias("known")).filter("known = 2")
    minus = lambda c: F.col(f"{c}_a") - F.col(f"{c}_b")
    counted = lambda c: F.coalesce(F.col(c), F.lit(0))
    surface_gap = counted("surface_days_inactive_a") - counted("surface_days_inactive_b") if historical else minus("surface_days_inactive")
    return wide.select(
        "event_id", *STATE, minus("elo").alias("delta_elo"), minus("days_inactive").alias("delta_inactivity_days"), surface_gap.alias("delta_surface_inactivity_days"),
        minus("surface_elo").alias("delta_surface_elo"),
    )


def build_features(spark: SparkSession, d: str, a: str, b: str, surface: str, day: str, historical: bool = False) -> DataFrame:
    """One row of state and differences; raises for a player without a state."""
    event = spark.createDataFrame([(0, a, b, surface)], "event_id long, player_a_id string, player_b_id string, surface string").withColumn("day", F.to_date(F.lit(day)))
    ratings = ratings_long(spark, d).filter(F.col("player_id").isin(a, b))
    row = match_features(event, ratings, historical)
    if row.isEmpty():
        have = {r["player_id"] for r in ratings.select("player_id").distinct().collect()}  # two at most
        raise ValueError(f"no state of {', '.join(p for p in (a, b) if p not in have) or 'a player by that day'}")
    return row.withColumns({"player_a_id": F.lit(a), "player_b_id": F.lit(b)}).drop("event_id")


def strategy_v3(probability: Column, delta_elo: Column, delta_surface_days: Column) -> Column:
    """The served strategy; unknown values don't qualify."""
    return F.coalesce((probability >= 0.5) & (delta_elo < 0) & (delta_surface_days < -14), F.lit(False))


def scored(model: PipelineModel, features: Sequence[str], rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``p``; the model's features that the rows lack are null and left to its imputer."""
    named = rows.withColumns({"delta_idle": F.col("delta_inactivity_days"), "delta_surface_idle": F.col("delta_surface_inactivity_days")})
    return score(model, with_features(named, features, keys)).select(*keys, "p")


def predict_match(
    spark: SparkSession, d: str, model: PipelineModel, notes: dict, a: str, b: str, surface: str, day: str, historical: bool = False
) -> dict:
    """Probability, states, differences, strategy flag, and the model's metadata and metrics."""
    rows = build_features(spark, d, a, b, surface.capitalize(), day, historical)
    out = rows.join(scored(model, notes["features"], rows, ["player_a_id"]), "player_a_id")
    row = out.withColumn("strategy_v3", strategy_v3(F.col("p"), F.col("delta_elo"), F.col("delta_surface_inactivity_days"))).first()
    number = lambda c: None if row[c] is None else float(row[c])
    return {"probability": row["p"], **{c: number(c) for c in (*STATE, *DELTAS)}, "strategy_v3": row["strategy_v3"], "metadata": notes.get("metadata", {}), "metrics": notes.get("metrics", {})}


def predict_fixtures(spark: SparkSession, d: str, model: PipelineModel, features: Sequence[str], fixtures: DataFrame) -> DataFrame:
    """Singles fixtures with odds whose players are known, with probabilities, edges, the better side,
    a tier and the strategy flag, largest edge first.

    ``fixtures``: ``payload_id, match_pos, date, surface, player1_name, player2_name, odds_p1, odds_p2`` as text."""
    known = player_lookup(spark, d).groupBy(canonical_name(F.col("name")).alias("key")).agg(F.min("player_id").alias("id"))
    rows = fixtures.withColumns({"day": F.substring("date", 1, 10).try_cast("date"), "odds_a": F.col("odds_p1").try_cast("double"), "odds_b": F.col("odds_p2").try_cast("double")}).filter("odds_a > 0 and odds_b > 0 and day is not null")
    for s, n in (("a", "player1_name"), ("b", "player2_name")):
        rows = rows.join(known.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(f"player_{s}_id")), canonical_name(F.col(n)) == F.col(f"key_{s}"))
    rows = rows.withColumn("event_id", F.struct("payload_id", "match_pos"))
    states = match_features(rows.select("event_id", "player_a_id", "player_b_id", "surface", "day"), ratings_long(spark, d))
    out = rows.join(states, "event_id").join(scored(model, features, states, ["event_id"]), "event_id")
    q = lambda s: 1 / F.col(f"odds_{s}")
    edge_a, edge_b = F.col("p") - q("a"), (1 - F.col("p")) - q("b")
    best = F.greatest(edge_a, edge_b)
    pick = F.when(best >= 0.05, F.when(edge_a > edge_b, F.col("player1_name")).otherwise(F.col("player2_name")))
    r = lambda c: half_even(c, 4)
    return out.select(
        "payload_id", "match_pos", "player_a_id", "player_b_id", "odds_a", "odds_b", r(q("a")).alias("market_prob_a"), r(q("b")).alias("market_prob_b"), r(F.col("p")).alias("probability_a"),
        r(1 - F.col("p")).alias("probability_b"), r(edge_a).alias("edge_a"), r(edge_b).alias("edge_b"), r(best).alias("max_edge"), confidence_tier(best).alias("confidence"),
        strategy_v3(F.col("p"), F.col("delta_elo"), F.col("delta_surface_inactivity_days")).alias("strategy_v3"), pick.alias("recommendation"),
    ).orderBy(F.col("max_edge").desc(), "payload_id", "match_pos")
