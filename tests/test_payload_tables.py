from pyspark.sql import functions as F

from rallygrid.plans import core_problems as p

SF = "/root/testdata/sf0.001"


def test_every_value_is_in_a_table(spark):
    values = p._payload_nodes(spark, SF).filter("value is not null").count()
    held = 0
    for name in ("p6_matches", "p6_players", "p6_tournaments", "p6_courts", "p6_odds"):
        df = getattr(p, name)(spark, SF)
        cells = [c for c in df.columns if c not in ("payload_id", "match_pos", "pre", "post", "side")]
        held += df.select(sum((F.col(c).isNotNull().cast("long") for c in cells), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert held == values > 0


def test_every_key_has_a_column(spark):
    known = {"[]." + k for k in p.P6_MATCH.values()} | {f"[].odds.{k}" for k in p.P6_ODDS.values()}
    known |= {f"[].player{i}.{k}" for i in (1, 2) for k in p.P6_PLAYER.values()}
    known |= {f"[].tournament.{k}" for k in p.P6_TOURNAMENT.values()} | {f"[].tournament.court.{k}" for k in p.P6_COURT.values()}
    nodes = p._payload_nodes(spark, "/root/testdata/sf0.01")
    objects = {r.path for r in nodes.filter("kind in ('object', 'array')").select("path").distinct().collect()}
    assert {r.path for r in nodes.select("path").distinct().collect()} - objects <= known
