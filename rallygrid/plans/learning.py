"""Model queries (trained here, so checked by rows and on fixtures) and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallygrid.ml import ablation, boosted_trees, calibrated, logistic, permutation_importance, score, sized, walk_forward
from rallygrid.functions.formulas import k_factor
from rallygrid.operators.joins import backward_asof
from rallygrid.operators.trailing_totals import once_per_match
from rallygrid.plans.base import bets, matches
from rallygrid.session import StepTables, cut_lineage, table
from rallygrid.streaming.state import distinct_deliveries, streaming_ratings, windowed_counts

FEATURES = ("delta_elo", "delta_surface_elo", "delta_idle", "delta_surface_idle")
WINDOWS = (5, 10, 20, 50)
#: Share in percent by its parts: summed columns above and below.
WON = {"win_pct": (("won_match",), ("played",))}
SERVICE = {
    "first_serve_in_pct": (("first_in",), ("svpt",)),
    "first_serve_won_pct": (("first_won",), ("first_in",)),
    "second_serve_won_pct": (("second_won",), ("second_in",)),
    "service_points_won_pct": (("first_won", "second_won"), ("svpt",)),
    "bp_saved_pct": (("bp_saved",), ("bp_faced",)),
}
RETURN = {
    "return_points_won_pct": (("return_won",), ("opp_svpt",)),
    "break_conversion_pct": (("breaks_converted",), ("break_points_generated",)),
}
RANKS = ("rank", "rank_points")


def _deltas(shares: dict) -> tuple[str, ...]:
    return tuple(f"delta_{s}_{n}" for s in shares for n in WINDOWS)


ELO = tuple(f"{c}_{s}" for c in ("elo", "surface_elo") for s in "ab") + FEATURES[:2]
IDLE = tuple(f"{c}_{s}" for c in ("idle", "surface_idle") for s in "ab") + FEATURES[2:]
RANKING = tuple(f"{p}{c}{q}" for c in RANKS for p, q in (("", "_a"), ("", "_b"), ("delta_", "")))
ALL = (*ELO, *IDLE, *RANKING, *_deltas(WON), *_deltas(SERVICE), *_deltas(RETURN))
#: The nine sets of the reference.
SETS = {
    "elo_only": ELO,
    "idle_only": IDLE,
    "ranking_only": RANKING,
    "winrate_only": _deltas(WON),
    "service_only": _deltas(SERVICE),
    "return_only": _deltas(RETURN),
    "all_without_elo": tuple(c for c in ALL if c not in ELO),
    "all_without_idle": tuple(c for c in ALL if c not in IDLE),
    "all": ALL,
}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(c) for c in FEATURES]
    return sized(cut_lineage(bets(spark, d).select("history_id", F.year("match_date").alias("year"), F.col("target").cast("double").alias("target"), "p_market", "profit", *doubles)))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """``player, known_on`` and the shares of the player's last N matches before that day."""
    once = once_per_match(table(spark, d, "analytics_player_matches")).filter("player_id is not null and match_day is not null")
    once = once.withColumns({
        "played": F.lit(1),
        "second_in": F.col("svpt") - F.col("first_in"),
        "return_won": F.col("opp_svpt") - F.col("opp_first_won") - F.col("opp_second_won"),
    })
    order = [F.col("match_day"), "tourney_id", "round", "opponent_id", "content_digest"]
    rows = Window.partitionBy("player_id").orderBy(*order)
    columns = {}
    for name, (above, below) in (WON | SERVICE | RETURN).items():
        # A match counts in a share only if all its parts are known.
        whole = sum((F.col(c) for c in (*above, *below)), F.lit(0)).isNotNull()
        for n in WINDOWS:
            w = rows.rowsBetween(1 - n, 0)
            part, total = (F.sum(F.when(whole, sum((F.col(c) for c in cs), F.lit(0)))).over(w) for cs in (above, below))
            columns[f"{name}_{n}"] = F.when(total > 0, 100.0 * part / total)
    shares = once.select("player_id", "match_day", *order[1:], *[c.alias(n) for n, c in columns.items()])
    newest = Window.partitionBy("player_id", "match_day").orderBy(*[F.col(c).desc() for c in order[1:]])
    return shares.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").select(
        F.col("player_id").alias("player"), F.date_add("match_day", 1).alias("known_on"), F.lit(0).alias("tie"), *columns
    )


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """``player, ranked_on`` and the rank the player was entered with on that day."""
    side = lambda w: F.struct(F.col(f"{w}_id").alias("player"), *[F.col(f"{w}_{c}").cast("double").alias(c) for c in RANKS])
    long = matches(spark, d).select("match_day", "row_id", F.explode(F.array(side("winner"), side("loser"))).alias("s"))
    return long.select("s.player", F.col("match_day").alias("ranked_on"), F.col("row_id").alias("rank_tie"), *[f"s.{c}" for c in RANKS]).filter("rank is not null or rank_points is not null")


def _wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """The mirrored rows with all features: ratings as recorded, ranks and shares as they stood
    before the match."""
    rated = table(spark, d, "player_elo_history").select(
        "history_id", *[F.col(f"{w}_{c}").cast("double").alias(f"{w}_{n}") for w in ("winner", "loser")
                        for c, n in (("elo_before", "elo"), ("surface_elo_before", "surface_elo"), ("days_inactive", "idle"), ("surface_days_inactive", "surface_idle"))]
    )
    base = cut_lineage(bets(spark, d).select("history_id", "match_date", "player", "opponent", F.col("target").cast("double").alias("target"), *[F.col(c).cast("double").alias(c) for c in FEATURES]))
    events = base.select(F.explode(F.array("player", "opponent")).alias("player"), F.col("match_date").cast("date").alias("day")).filter("player is not null").distinct()
    shares = [f"{s}_{n}" for s in WON | SERVICE | RETURN for n in WINDOWS]
    known = backward_asof(events, _states(spark, d), ["player"], "day", "known_on", "tie", shares)
    known = backward_asof(known, _ranks(spark, d), ["player"], "day", "ranked_on", "rank_tie", RANKS)
    known = cut_lineage(known.select("player", "day", *shares, *RANKS))
    out = base.withColumn("day", F.col("match_date").cast("date"))
    for at, who in (("a", "player"), ("b", "opponent")):
        side = known.select(F.col("player").alias(who), "day", *[F.col(c).alias(f"{c}_{at}") for c in (*shares, *RANKS)])
        out = out.join(side, [who, "day"], "left")
    won = F.col("target") == 1
    out = out.join(rated.dropDuplicates(["history_id"]), "history_id")
    for c in ("elo", "surface_elo", "idle", "surface_idle"):
        w, l = F.col(f"winner_{c}"), F.col(f"loser_{c}")
        out = out.withColumns({f"{c}_a": F.when(won, w).otherwise(l), f"{c}_b": F.when(won, l).otherwise(w)})
    out = out.withColumns({f"delta_{c}": F.col(f"{c}_a") - F.col(f"{c}_b") for c in (*shares, *RANKS)})
    # A table, as few of its columns are read at a time.
    return StepTables(spark).cut(out.select("history_id", F.year("match_date").alias("year"), "target", *ALL), keep=True)


def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    model = logistic(FEATURES).fit(rows.filter("year < 2022"))
    return score(model, rows.filter("year >= 2022")).select("history_id", "target", "p")


def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    model = boosted_trees(FEATURES).fit(rows.filter("year < 2022"))
    return score(model, rows.filter("year >= 2022")).select("history_id", "target", "p")


def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return calibrated(boosted_trees(FEATURES), rows.filter("year < 2022"), "history_id")(rows.filter("year >= 2022")).select("history_id", "target", "p")


def walk_forward_metrics(spark: SparkSession, d: str) -> DataFrame:
    return walk_forward(_rows(spark, d), "year", (2021, 2022, 2023, 2024, 2025), FEATURES, boosted_trees, "profit", "p_market")


def ablation_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide_rows(spark, d)
    return ablation(rows.filter("year < 2022"), rows.filter("year >= 2022"), SETS, boosted_trees)


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    model = boosted_trees(FEATURES).fit(rows.filter("year < 2022"))
    return permutation_importance(model, rows.filter("year >= 2022"), FEATURES, "history_id")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Drain a stream over files to a table in the checkpoint folder and read it."""
    spark = stream.sparkSession
    from rallygrid.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "complete":
        # Files can only be appended to; each batch holds the whole result, so the last one stays.
        q = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        q = writer.format("parquet").start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/ongoing_tourneys.parquet"
    schema = table(spark, d, "ongoing_tourneys").schema
    # A single file can't be the root of a stream: read its folder and keep its name.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the matches delivered; which delivery of a key comes first is open, so only keys."""
    return _run(distinct_deliveries(_feed(spark, d), ["tourney_id", "match_num"], "loaded_at").select("tourney_id", "match_num"), "append")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries per week and surface; complete mode, so windows open at the end count too."""
    return _run(windowed_counts(_feed(spark, d), "loaded_at", "surface", "7 days"), "complete")


def stream_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Surface ratings as matches arrive, with K by level and idle days and decay."""
    rows = _feed(spark, d).filter("surface is not null and winner_id is not null and loser_id is not null")
    rows = rows.select("row_id", "tourney_id", "match_num", "surface", "winner_id", "loser_id", F.col("loaded_at").alias("at"), k_factor(F.col("tourney_level"), F.lit(0)).alias("k"))
    return _run(streaming_ratings(rows), "append")


QUERIES = {
    f.__name__: f
    for f in (logistic_scores, gbt_scores, calibrated_scores, walk_forward_metrics, ablation_metrics, feature_importance, stream_distinct, stream_counts, stream_ratings)
}
ORACLES: dict[str, str] = {
    "stream_distinct": "SELECT DISTINCT tourney_id, match_num FROM ongoing_tourneys",
    "stream_counts": "SELECT time_bucket(INTERVAL 7 DAY, loaded_at, TIMESTAMP '1970-01-01') AS start, surface, count(*) AS n FROM ongoing_tourneys WHERE loaded_at IS NOT NULL GROUP BY 1, 2",
}
