"""Queries of the llm problems (2, 3, 5, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.llm.cut_text import cut_rates, judge_endings
from rallygrid.llm.leak_search import find_leaks
from rallygrid.llm.linkage import link_records
from rallygrid.llm.nearest_time import nearest_in_time
from rallygrid.llm.paired_ranking import probit_ranking
from rallygrid.llm.source_mix import mix_shares, mix_sources
from rallygrid.session import cut_lineage, table

WEEK_MICROS = 7 * 24 * 3600 * 1_000_000


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    key = F.lower(F.trim("pair_key")).alias("entity")
    matches = table(spark, d, "training_matches").select(F.col("match_id").alias("id"), key, F.col("match_date").alias("t"))
    odds = table(spark, d, "atp_odds").select(F.col("odds_id").alias("id"), key, F.col("Date").alias("t"))
    return nearest_in_time(matches, odds, WEEK_MICROS).toDF("match_id", "odds_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Listings with their match and the confidence of the link."""
    listings = table(spark, d, "bookmaker_listings").select(
        F.col("listing_id").alias("id"),
        F.col("Winner").alias("first"),
        F.col("Loser").alias("second"),
        F.lit(True).alias("oriented"),
        F.col("Date").alias("t"),
        F.col("Surface").alias("surface"),
        F.col("Series").alias("level"),
    )
    b_won = F.coalesce(F.col("target") == 0, F.lit(False))
    matches = table(spark, d, "training_matches").select(
        F.col("match_id").alias("id"),
        F.when(b_won, F.col("player_b")).otherwise(F.col("player_a")).alias("first"),
        F.when(b_won, F.col("player_a")).otherwise(F.col("player_b")).alias("second"),
        F.col("target").isNotNull().alias("oriented"),
        F.col("match_date").alias("t"),
        "surface",
        F.col("tourney_level").alias("level"),
    )
    return link_records(listings, matches).toDF("listing_id", "match_id", "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_links(spark, d).select("match_id", "listing_id")


def _comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Each match once - of repeated deliveries the latest, then the largest row id - in the
    scope of all surfaces and in that of its own."""
    feed = table(spark, d, "ongoing_tourneys").select(
        "tourney_id", "match_num", "loaded_at", "row_id", "winner_id", "loser_id", F.lower(F.trim("surface")).alias("surface")
    )
    keyless = F.when(F.col("tourney_id").isNull() | F.col("match_num").isNull(), F.col("row_id"))
    once = feed.groupBy("tourney_id", "match_num", keyless.alias("keyless")).agg(
        F.max_by(F.struct("winner_id", "loser_id", "surface"), F.struct("loaded_at", "row_id")).alias("m")
    )
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("m.surface") != "", F.col("m.surface"))))
    return once.select(F.explode(scopes).alias("scope"), F.col("m.winner_id").alias("winner"), F.col("m.loser_id").alias("loser"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return probit_ranking(_comparisons(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(cut_lineage(p9_mix(spark, d)), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_endings(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_rates(judge_endings(table(spark, d, "documents")))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p5_ranking": p5_ranking,
    "p8_found": p8_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
