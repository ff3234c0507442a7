"""Repeated deliveries and corrections count once in what queries start from."""

from pyspark.sql import functions as F

from rallygrid.plans import base
from rallygrid.plans.players import form_last10
from rallygrid.session import table

SF = "/root/testdata/sf0.001"


def _planted(spark, tmp_path, name, change):
    t = table(spark, SF, name)
    t.unionByName(change(t)).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_repeats_change_no_form(spark, tmp_path):
    again = lambda t: t.withColumn("row_id", F.col("row_id") + 10_000_000).withColumn("loaded_at", F.col("loaded_at") + F.expr("interval 1 day"))
    _planted(spark, tmp_path, "analytics_player_matches", again)
    rows = base.player_matches(spark, str(tmp_path))
    assert rows.count() == base.player_matches(spark, SF).count()
    assert rows.filter("row_id < 10000000").count() == 0  # the latest delivery
    key = ["player_id", "opponent_id", "tourney_id", "round", "won_match", "svpt", "match_day"]
    assert rows.groupBy(*key, "minutes", "ace").count().filter("count > 1").count() == 0
    form = lambda d: sorted((r.player_id, r.surface, r.matches) for r in form_last10(spark, d).collect())
    assert form(str(tmp_path)) == form(SF)


def test_corrections_are_one_bet(spark, tmp_path):
    later = lambda t: t.withColumn("history_id", F.col("history_id") + 10_000_000).withColumn("recorded_at", F.col("recorded_at") + F.expr("interval 100 days"))
    _planted(spark, tmp_path, "player_elo_history", later)
    rows = base.bets(spark, str(tmp_path))
    assert rows.count() == base.bets(spark, SF).count()
    assert rows.filter("history_id < 10000000").count() == 0


def test_rows_without_a_key_stand_for_themselves(spark, tmp_path):
    table(spark, SF, "ongoing_tourneys").withColumn("match_num", F.lit(None).cast("int")).write.parquet(str(tmp_path / "ongoing_tourneys.parquet"))
    feed = table(spark, str(tmp_path), "ongoing_tourneys")
    assert base.matches(spark, str(tmp_path)).count() > 0.9 * feed.count()
