"""Backtest queries: sweeps, buckets, scenarios, strategies, curves, calibration, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallygrid.functions.buckets import cut, cut_sql, dimension, label
from rallygrid.functions.formulas import confidence_tier
from rallygrid.operators.evaluate import auc, class_report, exact_quantiles, probability_scores
from rallygrid.plans.base import BETS, bets

#: Bucket edges and thresholds (fixed values).
PROBABILITY = (0, 0.4, 0.5, 0.6, 0.7, 0.8, 1)
ODDS = (1, 1.5, 2, 3, 5, 100)
IDLE = (-10000, -60, -30, -14, -7, 0, 7, 14, 30, 60, 10000)
ELO = (-9999, -200, -100, 0, 100, 200, 9999)
SURFACE_IDLE = (-9999, -30, -14, -7, 0, 7, 14, 30, 9999)
THRESHOLDS = (0.0, 0.02, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
ODDS_FACTORS = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8)
COMMISSIONS = (0.0, 0.02, 0.05)
PENALTIES = (0.0, 0.02, 0.05, 0.1)


def _stats():
    r = lambda c: F.round(F.avg(c), 6)
    return [
        F.count("*").alias("n"),
        F.sum("target").cast("long").alias("wins"),
        r("target").alias("hit"),
        r("profit").alias("roi"),
        r("odds").alias("avg_odds"),
    ]


_STATS_SQL = "count(*) AS n, CAST(sum(target) AS BIGINT) AS wins, round(avg(target), 6) AS hit, round(avg(profit), 6) AS roi, round(avg(odds), 6) AS avg_odds"


def roi_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    """All thresholds in one pass: each bet unfolds to the thresholds it clears."""
    over = F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: F.col("edge") > t)
    return bets(spark, d).withColumn("threshold", F.explode(over)).groupBy("threshold").agg(*_stats())


def roi_by_odds_bucket(spark: SparkSession, d: str) -> DataFrame:
    return (
        bets(spark, d).withColumn("bucket", cut(F.col("odds"), ODDS, True)).filter("bucket is not null").groupBy("bucket").agg(*_stats())
        .withColumn("label", label(F.col("bucket"), ODDS))
    )


def roi_by_year(spark: SparkSession, d: str) -> DataFrame:
    return bets(spark, d).filter("edge > 0.05").groupBy(F.year("match_date").cast("long").alias("year")).agg(*_stats())


def roi_by_surface(spark: SparkSession, d: str) -> DataFrame:
    return bets(spark, d).filter("edge > 0.05 and surface is not null").groupBy("surface").agg(*_stats())


def roi_fav_dog(spark: SparkSession, d: str) -> DataFrame:
    """Favourites and underdogs; a market probability of exactly one half is in neither."""
    side = F.when(F.col("p_market") > 0.5, "favourite").when(F.col("p_market") < 0.5, "underdog")
    return bets(spark, d).filter("edge > 0.05").withColumn("side", side).filter("side is not null").groupBy("side").agg(*_stats())


def roi_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Stress scenarios in one scan: lower odds, commission, a penalty on the model."""
    kinds = [("odds", f) for f in ODDS_FACTORS] + [("commission", c) for c in COMMISSIONS] + [("penalty", p) for p in PENALTIES]
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("x")) for k, v in kinds]))
    rows = bets(spark, d).withColumn("s", grid).select("*", "s.kind", "s.x")
    won = F.when(F.col("kind") == "odds", F.col("odds") * F.col("x") - 1).when(
        F.col("kind") == "commission", (F.col("odds") - 1) * (1 - F.col("x"))
    ).otherwise(F.col("odds") - 1)
    edge = F.col("edge") - F.when(F.col("kind") == "penalty", F.col("x")).otherwise(0.0)
    return rows.filter(edge > 0.05).withColumn("p2", F.when(F.col("target") == 1, won).otherwise(-1.0)).groupBy("kind", "x").agg(
        F.count("*").alias("n"), F.round(F.avg("p2"), 6).alias("roi")
    )


def roi_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rating gap by idle gap; only combinations that occur."""
    return (
        bets(spark, d)
        .withColumn("elo_bucket", cut(F.col("delta_elo"), ELO))
        .withColumn("idle_bucket", cut(F.col("delta_surface_idle").cast("double"), SURFACE_IDLE))
        .filter("elo_bucket is not null and idle_bucket is not null")
        .groupBy("elo_bucket", "idle_bucket")
        .agg(*_stats())
    )


def bucket_summary_complete(spark: SparkSession, d: str) -> DataFrame:
    """Idle buckets, the empty ones with n = 0."""
    own = bets(spark, d).withColumn("bucket", cut(F.col("delta_idle").cast("double"), IDLE)).groupBy("bucket").agg(
        F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("mean_target")
    )
    return dimension(spark, IDLE).join(own, "bucket", "left").fillna(0, ["n"])


STRATEGIES = {
    "A": "edge > 0.05",
    "B": "edge > 0.05 and delta_elo < 0",
    "C": "edge > 0.05 and delta_surface_idle < -14",
    "D": "edge > 0.10 and delta_elo < 0 and delta_surface_idle < -14",
}


def strategy_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping named masks in one pass; a strategy without bets has n = 0."""
    names = F.array_compact(F.array(*[F.when(F.expr(m), F.lit(n)) for n, m in STRATEGIES.items()]))
    own = bets(spark, d).withColumn("strategy", F.explode(names)).groupBy("strategy").agg(*_stats())
    return spark.createDataFrame([(n,) for n in STRATEGIES], "strategy string").join(own, "strategy", "left").fillna(0, ["n"])


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative profit and running peak per surface, in two levels: months, then rows of a
    month, so that no task orders all bets of a surface."""
    chosen = bets(spark, d).filter("edge > 0.05 and surface is not null").select(
        "surface", "match_date", "history_id", "target", F.round(F.col("profit") * 10000).cast("long").alias("pnl"), F.trunc("match_date", "month").alias("month")
    )
    inside = Window.partitionBy("surface", "month").orderBy("match_date", "history_id", "target").rowsBetween(Window.unboundedPreceding, 0)
    rows = chosen.withColumn("cum", F.sum("pnl").over(inside)).withColumn("top", F.max("cum").over(inside))
    months = rows.groupBy("surface", "month").agg(F.sum("pnl").alias("sum"), F.max("cum").alias("high"))
    before = Window.partitionBy("surface").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).withColumn(
        "peak", F.max(F.col("base") + F.col("high")).over(before)
    )
    joined = rows.join(months.select("surface", "month", "base", "peak"), ["surface", "month"])
    total = F.col("base") + F.col("cum")
    return joined.select(
        "surface", "match_date", "history_id", "target", total.alias("cumulative"),
        F.greatest(F.col("base") + F.col("top"), F.col("peak")).alias("running_peak"),
    ).withColumn("drawdown", F.col("cumulative") - F.col("running_peak"))


def drawdown_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d)


def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).groupBy("surface").agg(F.min("drawdown").alias("max_drawdown"), F.max("cumulative").alias("best"), F.count("*").alias("n"))


def streaks(spark: SparkSession, d: str) -> DataFrame:
    """Longest winning and losing runs per player (gaps and islands)."""
    w = Window.partitionBy("player").orderBy("match_date", "history_id")
    v = Window.partitionBy("player", "target").orderBy("match_date", "history_id")
    rows = bets(spark, d).select("player", "target", "match_date", "history_id")
    runs = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v)).groupBy("player", "target", "island").agg(F.count("*").alias("n"))
    longest = lambda t: F.coalesce(F.max(F.when(F.col("target") == t, F.col("n"))), F.lit(0)).alias
    return runs.groupBy("player").agg(longest(1)("longest_win"), longest(0)("longest_loss"))


def decile_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Quantile buckets of the model probability, closed right; equal edges fall together."""
    rows = bets(spark, d)
    whole = rows.withColumn("everyone", F.lit(1))
    edges = exact_quantiles(whole, "p_model", [i / 10 for i in range(11)], ["everyone"]).select(F.array_distinct("q").alias("e"))  # one row
    bucket = F.size(F.filter("e", lambda x: x < F.col("p_model")))
    out = rows.join(F.broadcast(edges)).withColumn("bucket", F.greatest(bucket, F.lit(1)))
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("p_model"), 6).alias("mean_p"), F.round(F.avg("target"), 6).alias("mean_target"))


def uniform_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Ten equal bins of probability, empty ones dropped."""
    return bets(spark, d).groupBy(F.least(F.floor(F.col("p_model") * 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg("p_model"), 6).alias("mean_p"), F.round(F.avg("target"), 6).alias("mean_target")
    )


def probability_buckets(spark: SparkSession, d: str) -> DataFrame:
    return bets(spark, d).withColumn("bucket", cut(F.col("p_model"), PROBABILITY)).filter("bucket is not null").groupBy("bucket").agg(*_stats())


def clf_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = bets(spark, d).withColumn("everyone", F.lit("all"))
    scores = probability_scores(rows, "target", "p_model", ["everyone"])
    out = scores.join(auc(rows, "target", "p_model", ["everyone"]), "everyone")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss", "auc")])


def clf_metrics_by_surface(spark: SparkSession, d: str) -> DataFrame:
    rows = bets(spark, d).filter("surface is not null")
    out = probability_scores(rows, "target", "p_model", ["surface"]).join(auc(rows, "target", "p_model", ["surface"]), "surface")
    return out.select("surface", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss", "auc")])


def class_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = bets(spark, d).withColumn("guess", (F.col("p_model") >= 0.5).cast("int"))
    return class_report(rows, "target", "guess").select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def correlation(spark: SparkSession, d: str) -> DataFrame:
    pairs = (("delta_elo", "target"), ("delta_idle", "target"), ("delta_elo", "delta_surface_elo"))
    return bets(spark, d).agg(*[F.round(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in pairs])


def activity_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of winners that were idle less; unknown counts as not."""
    less = F.coalesce(F.col("delta_idle") < 0, F.lit(False)).cast("int")
    return bets(spark, d).filter("target = 1 and surface is not null").groupBy("surface").agg(F.count("*").alias("n"), F.round(F.avg(less), 6).alias("rate"))


def describe_stats(spark: SparkSession, d: str) -> DataFrame:
    q = exact_quantiles(bets(spark, d), "edge", (0.25, 0.5, 0.75), ["target"])
    s = bets(spark, d).groupBy("target").agg(
        F.count("edge").alias("count"), F.avg("edge").alias("mean"), F.stddev_samp("edge").alias("std"), F.min("edge").alias("min"), F.max("edge").alias("max")
    ).join(q, "target")
    return s.select("target", "count", *[F.round(c, 6).alias(n) for c, n in (("mean", "mean"), ("std", "std"), ("min", "min"), (F.col("q")[0], "p25"), (F.col("q")[1], "p50"), (F.col("q")[2], "p75"), ("max", "max"))])


def model_vs_market(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and return of the picks each probability makes (p >= 0.5)."""
    sides = F.explode(F.array(F.struct(F.lit("model").alias("who"), F.col("p_model").alias("p")), F.struct(F.lit("market").alias("who"), F.col("p_market").alias("p"))))
    return bets(spark, d).withColumn("s", sides).filter("s.p >= 0.5").groupBy(F.col("s.who").alias("who")).agg(*_stats())


def unique_best_pick(spark: SparkSession, d: str) -> DataFrame:
    """The better of the two mirrored rows of each match: a pre-aggregated maximum."""
    best = F.max_by(F.struct("player", "target", "p_model"), F.struct("p_model", "player"))
    return bets(spark, d).groupBy("history_id").agg(best.alias("b")).select("history_id", "b.player", "b.target", F.round("b.p_model", 6).alias("p_model"))


def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return bets(spark, d).groupBy(confidence_tier(F.col("edge")).alias("tier")).agg(*_stats())


def zone_uplift(spark: SparkSession, d: str) -> DataFrame:
    zone = F.expr(STRATEGIES["D"])
    s = bets(spark, d).agg(F.avg("profit").alias("a"), F.avg(F.when(zone, F.col("profit"))).alias("z"))
    return s.select(F.round("a", 6).alias("roi_all"), F.round("z", 6).alias("roi_zone"), F.round(F.col("z") - F.col("a"), 6).alias("uplift"))


_ALL = (
    roi_by_threshold, roi_by_odds_bucket, roi_by_year, roi_by_surface, roi_fav_dog, roi_scenarios, roi_matrix, bucket_summary_complete,
    strategy_comparison, drawdown_curve, max_drawdown, streaks, decile_calibration, uniform_calibration, probability_buckets, clf_metrics,
    clf_metrics_by_surface, class_reports, correlation, activity_rate, describe_stats, model_vs_market, unique_best_pick, confidence_tiers, zone_uplift,
)
QUERIES = {f.__name__: f for f in _ALL}

_CURVE = f"""WITH {BETS}, c AS (SELECT surface, match_date, history_id, target, CAST(round(profit*10000) AS BIGINT) AS pnl FROM bets WHERE edge > 0.05 AND surface IS NOT NULL
), d AS (SELECT surface, match_date, history_id, target, CAST(sum(pnl) OVER (PARTITION BY surface ORDER BY match_date, history_id, target ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM c
), e AS (SELECT *, max(cumulative) OVER (PARTITION BY surface ORDER BY match_date, history_id, target ROWS UNBOUNDED PRECEDING) AS running_peak FROM d)
"""
_METRICS = """SELECT {g} count(*) AS n, round(avg(CASE WHEN (p_model >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((p_model-target)*(p_model-target)), 6) AS brier,
 round(avg(-target*ln(greatest(1e-15, least(1-1e-15, p_model))) - (1-target)*ln(1-greatest(1e-15, least(1-1e-15, p_model)))), 6) AS log_loss,
 round((sum(CASE WHEN target = 1 THEN r END) - sum(target)*(sum(target)+1)/2.0) / (sum(target)*(count(*)-sum(target))), 6) AS auc
FROM (SELECT *, (rank() OVER ({p} ORDER BY p_model) + rank() OVER ({p} ORDER BY p_model) + count(*) OVER (PARTITION BY {q} p_model) - 1)/2.0 AS r FROM bets {w}) {b}"""


def _labels(edges) -> str:
    arms = " ".join(f"WHEN {i} THEN '{lo:g}:{hi:g}'" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return f"CASE bucket {arms} END"


def _values(xs) -> str:
    return ", ".join(f"({x})" for x in xs)


ORACLES = {
    "roi_by_threshold": f"WITH {BETS} SELECT CAST(t AS DOUBLE) AS threshold, {_STATS_SQL} FROM bets JOIN (VALUES {_values(THRESHOLDS)}) v(t) ON edge > CAST(t AS DOUBLE) GROUP BY t",
    "roi_by_odds_bucket": f"WITH {BETS}, x AS (SELECT *, {cut_sql('odds', ODDS, True)} AS bucket FROM bets) SELECT bucket, {_labels(ODDS)} AS label, {_STATS_SQL} FROM x WHERE bucket IS NOT NULL GROUP BY bucket",
    "roi_by_year": f"WITH {BETS} SELECT CAST(year(match_date) AS BIGINT) AS year, {_STATS_SQL} FROM bets WHERE edge > 0.05 GROUP BY 1",
    "roi_by_surface": f"WITH {BETS} SELECT surface, {_STATS_SQL} FROM bets WHERE edge > 0.05 AND surface IS NOT NULL GROUP BY 1",
    "roi_fav_dog": f"WITH {BETS} SELECT CASE WHEN p_market > 0.5 THEN 'favourite' ELSE 'underdog' END AS side, {_STATS_SQL} FROM bets WHERE edge > 0.05 AND p_market <> 0.5 GROUP BY 1",
    "roi_scenarios": f"""WITH {BETS}, s AS (SELECT 'odds' AS kind, CAST(x AS DOUBLE) AS x FROM (VALUES {_values(ODDS_FACTORS)}) v(x) UNION ALL SELECT 'commission', CAST(x AS DOUBLE) FROM (VALUES {_values(COMMISSIONS)}) v(x) UNION ALL SELECT 'penalty', CAST(x AS DOUBLE) FROM (VALUES {_values(PENALTIES)}) v(x))
SELECT kind, x, count(*) AS n, round(avg(CASE WHEN target = 0 THEN -1.0 WHEN kind = 'odds' THEN odds*x - 1 WHEN kind = 'commission' THEN (odds-1)*(1-x) ELSE odds - 1 END), 6) AS roi
FROM bets, s WHERE edge - CASE WHEN kind = 'penalty' THEN x ELSE 0.0 END > 0.05 GROUP BY kind, x""",
    "roi_matrix": f"WITH {BETS}, x AS (SELECT *, {cut_sql('delta_elo', ELO)} AS elo_bucket, {cut_sql('delta_surface_idle', SURFACE_IDLE)} AS idle_bucket FROM bets) SELECT elo_bucket, idle_bucket, {_STATS_SQL} FROM x WHERE elo_bucket IS NOT NULL AND idle_bucket IS NOT NULL GROUP BY ALL",
    "bucket_summary_complete": f"WITH {BETS}, x AS (SELECT {cut_sql('delta_idle', IDLE)} AS bucket, count(*) AS n, round(avg(target), 6) AS mean_target FROM bets GROUP BY 1), dim AS (SELECT CAST(i AS INTEGER) AS bucket FROM range({len(IDLE) - 1}) r(i)) SELECT bucket, {_labels(IDLE)} AS label, coalesce(n, 0) AS n, mean_target FROM dim LEFT JOIN x USING (bucket)",
    "strategy_comparison": f"WITH {BETS} " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {_STATS_SQL} FROM bets WHERE {m}" for n, m in STRATEGIES.items()),
    "drawdown_curve": _CURVE + "SELECT *, cumulative - running_peak AS drawdown FROM e",
    "max_drawdown": _CURVE + "SELECT surface, min(cumulative - running_peak) AS max_drawdown, max(cumulative) AS best, count(*) AS n FROM e GROUP BY surface",
    "streaks": f"""WITH {BETS}, i AS (SELECT player, target, row_number() OVER (PARTITION BY player ORDER BY match_date, history_id) - row_number() OVER (PARTITION BY player, target ORDER BY match_date, history_id) AS island FROM bets),
r AS (SELECT player, target, island, count(*) AS n FROM i GROUP BY ALL)
SELECT player, coalesce(max(CASE WHEN target = 1 THEN n END), 0) AS longest_win, coalesce(max(CASE WHEN target = 0 THEN n END), 0) AS longest_loss FROM r GROUP BY player""",
    "decile_calibration": f"""WITH {BETS}, q AS (SELECT list_distinct(quantile_cont(p_model, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS e FROM bets)
SELECT CAST(greatest(len(list_filter(e, lambda x: x < p_model)), 1) AS INTEGER) AS bucket, count(*) AS n, round(avg(p_model), 6) AS mean_p, round(avg(target), 6) AS mean_target FROM bets, q GROUP BY 1""",
    "uniform_calibration": f"WITH {BETS} SELECT CAST(least(floor(p_model*10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p_model), 6) AS mean_p, round(avg(target), 6) AS mean_target FROM bets GROUP BY 1",
    "probability_buckets": f"WITH {BETS}, x AS (SELECT *, {cut_sql('p_model', PROBABILITY)} AS bucket FROM bets) SELECT bucket, {_STATS_SQL} FROM x WHERE bucket IS NOT NULL GROUP BY bucket",
    "clf_metrics": f"WITH {BETS} " + _METRICS.format(g="", p="", q="", w="", b=""),
    "clf_metrics_by_surface": f"WITH {BETS} " + _METRICS.format(g="surface,", p="PARTITION BY surface", q="surface,", w="WHERE surface IS NOT NULL", b="GROUP BY surface"),
    "class_reports": f"""WITH {BETS}, x AS (SELECT target, CAST(p_model >= 0.5 AS INTEGER) AS guess FROM bets), c AS (SELECT unnest([0, 1]) AS class),
y AS (SELECT class, sum(CASE WHEN target = class THEN 1 ELSE 0 END) AS s, sum(CASE WHEN guess = class THEN 1 ELSE 0 END) AS g, sum(CASE WHEN guess = class AND target = class THEN 1 ELSE 0 END) AS h FROM x, c GROUP BY class)
SELECT class, CAST(s AS BIGINT) AS support, round(h/g, 6) AS precision, round(h/s, 6) AS recall, round(2*h/(s+g), 6) AS f1 FROM y""",
    "correlation": f"WITH {BETS} SELECT round(corr(delta_elo, target), 6) AS delta_elo_target, round(corr(delta_idle, target), 6) AS delta_idle_target, round(corr(delta_elo, delta_surface_elo), 6) AS delta_elo_delta_surface_elo FROM bets",
    "activity_rate": f"WITH {BETS} SELECT surface, count(*) AS n, round(avg(CASE WHEN delta_idle < 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM bets WHERE target = 1 AND surface IS NOT NULL GROUP BY 1",
    "describe_stats": f"WITH {BETS} SELECT target, count(edge) AS count, round(avg(edge), 6) AS mean, round(stddev_samp(edge), 6) AS std, round(min(edge), 6) AS min, round(quantile_cont(edge, 0.25), 6) AS p25, round(quantile_cont(edge, 0.5), 6) AS p50, round(quantile_cont(edge, 0.75), 6) AS p75, round(max(edge), 6) AS max FROM bets GROUP BY target",
    "model_vs_market": f"WITH {BETS} SELECT 'model' AS who, {_STATS_SQL} FROM bets WHERE p_model >= 0.5 UNION ALL SELECT 'market', {_STATS_SQL} FROM bets WHERE p_market >= 0.5",
    "unique_best_pick": f"WITH {BETS} SELECT history_id, player, target, round(p_model, 6) AS p_model FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY p_model DESC, player DESC) AS rn FROM bets) WHERE rn = 1",
    "confidence_tiers": f"WITH {BETS} SELECT CASE WHEN edge >= 0.15 THEN 'HIGH' WHEN edge >= 0.10 THEN 'MEDIUM' WHEN edge >= 0.05 THEN 'LOW' ELSE 'NONE' END AS tier, {_STATS_SQL} FROM bets GROUP BY 1",
    "zone_uplift": f"WITH {BETS} SELECT round(avg(profit), 6) AS roi_all, round(avg(profit) FILTER ({STRATEGIES['D']}), 6) AS roi_zone, round(avg(profit) FILTER ({STRATEGIES['D']}) - avg(profit), 6) AS uplift FROM bets",
}
