import json

import pytest
from pyspark.sql import types as T

from rallygrid import ml, serving
from rallygrid.functions.buckets import cut
from rallygrid.operators.consolidate import append_new
from rallygrid.plans.learning import FEATURES, _rows
from rallygrid.sources import scans, sinks

SF = "/root/testdata/sf0.001"


def test_csv_scan(spark, tmp_path):
    (tmp_path / "2020.csv").write_text("tourney_id,minutes\nA,90\nB,x\n")
    (tmp_path / "2021_wta.csv").write_text("tourney_id,minutes\nC,1\n")
    df = scans.scan_csv(spark, str(tmp_path), scans.feed_schema(["tourney_id", "minutes"]), skip_names=["_wta"])
    assert sorted((r.tourney_id, r.minutes, r.season) for r in df.collect()) == [("A", 90, 2020), ("B", None, 2020)]
    sinks.write_parquet(df.drop("_corrupt"), str(tmp_path / "sub" / "x.parquet"))
    mixed = scans.scan_mixed(spark, str(tmp_path), scans.feed_schema(["tourney_id", "minutes"]))
    assert mixed.count() >= 5
    report = {r.source_file: (r.n, r.n_corrupt) for r in scans.scan_report(mixed).collect()}
    assert report["2020.csv"] == (2, 1)
    sinks.write_parquet_indexed(df.select("tourney_id"), str(tmp_path / "indexed"), [df.tourney_id.desc()])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "indexed")).collect())) == [("A", 1), ("B", 0)]
    assert sinks.remove(str(tmp_path / "indexed")) and not sinks.remove(str(tmp_path / "indexed"))
    with pytest.raises(ValueError):
        scans.require_rows(df.limit(0), "nothing")


def test_json_list_and_report(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"total": 2, "matches": [{"id": 1}, None]}))
    schema = T.StructType.fromDDL("total long, matches array<struct<id: long>>")
    out = scans.scan_json_list(spark, str(tmp_path / "a.json"), "matches", schema)
    assert [(r.pos, r.item and r.item.id) for r in out.orderBy("pos").collect()] == [(1, 1), (2, None)]
    sinks.write_report(out.select("pos"), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 2


def test_buckets_close_right(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (2.1,), (None,)], "x double")
    assert [r[0] for r in df.select(cut(df.x, (0, 1, 2))).collect()] == [None, 0, 1, 1, None, None]
    assert df.select(cut(df.x, (0, 1, 2), True)).first()[0] == 0


def test_append_new(spark):
    old = spark.createDataFrame([("a", 1), (None, 1)], "k string, x int")
    new = spark.createDataFrame([("a", "p"), ("b", "q"), (None, "r")], "k string, y string")
    assert sorted((str(r.k), r.x, r.y) for r in append_new(old, new, ["k"]).collect() if r.y) == [("None", None, "r"), ("b", None, "q")]


def test_models_and_serving(spark, tmp_path):
    rows = _rows(spark, SF)
    model = ml.logistic(FEATURES[:2]).fit(rows)
    folder = sinks.model_folder(str(tmp_path), "ATP", "Hard", "logistic", "v1")
    sinks.save_model(model, folder, list(FEATURES[:2]), {"auc": 1})
    again, notes = sinks.load_model(folder)
    assert notes["features"] == list(FEATURES[:2])
    a, b = [r.player_id for r in spark.sql(f"select winner_id as player_id from parquet.`{SF}/player_elo_history.parquet` where surface = 'Hard' and winner_surface_elo_before is not null and winner_elo_before is not null group by 1 order by count(*) desc, 1 limit 2").collect()]
    p = serving.predict_match(spark, SF, again, notes, a, b, "hard", "2030-01-01")
    assert len(p) == 15 and 0 < p["probability"] < 1 and p["metrics"] == {"auc": 1}
    assert p["delta_elo"] == p["elo_a"] - p["elo_b"] and p["delta_inactivity_days"] == p["days_inactive_a"] - p["days_inactive_b"]
    assert p["strategy_v3"] == (p["probability"] >= 0.5 and p["delta_elo"] < 0 and p["delta_surface_inactivity_days"] < -14)
    then = serving.predict_match(spark, SF, again, notes, a, b, "hard", "2029-12-31", historical=True)
    assert then["days_inactive_a"] == p["days_inactive_a"] - 1
    assert serving.get_player_id(spark, SF, serving.get_player_name(spark, SF, a)) is not None
    both = serving.analyze(spark, SF, a, b, "Hard")
    assert both["h2h"]["n"] == both["h2h"]["wins_a"] + both["h2h"]["wins_b"]
    m = serving.build_player_metrics(spark, SF, a, "Hard", ["G", "M", "A", "500", "250", "C", "F", "D"], "LAST_10_MATCHES")
    assert 0 < m["matches"] <= 10 and m["losses"] == m["matches"] - m["wins"]
    assert serving.build_player_metrics(spark, SF, "nobody", "Hard", ["G"], "CAREER") is None
    edges = serving.compare_edges(spark, SF, a, b, "Hard").collect()
    assert [r.abs_edge for r in edges] == sorted((r.abs_edge for r in edges), reverse=True)
    with pytest.raises(ValueError, match="nobody"):
        serving.build_features(spark, SF, a, "nobody", "Hard", "2030-01-01")


def test_features_of_known_states(spark):
    import datetime as dt

    d = lambda n: dt.date(2020, 1, n)
    ratings = [(1, d(1), "Hard", "a", 1600.0, 1550.0), (2, d(5), "Clay", "a", 1700.0, 1600.0), (3, d(2), "Hard", "b", 1500.0, 1450.0)]
    r = spark.createDataFrame(ratings, "history_id long, match_date date, surface string, player_id string, elo double, surface_elo double")
    e = spark.createDataFrame([(1, "a", "b", "Hard", d(4)), (2, "b", "a", "Clay", d(9)), (3, "a", "zz", "Hard", d(5))], "event_id long, player_a_id string, player_b_id string, surface string, day date")
    pick = lambda h: {x.event_id: (x.delta_elo, x.delta_inactivity_days, x.surface_elo_a, x.delta_surface_inactivity_days) for x in serving.match_features(e, r, h).collect()}
    assert pick(True) == {1: (100.0, 1, 1550.0, 1), 2: (-200.0, 3, None, -4)}
    assert pick(False) == {1: (200.0, -3, 1550.0, 1), 2: (-200.0, 3, None, None)}


def test_training_entry_point(spark, tmp_path):
    from rallygrid.train import train_model

    metrics = train_model(spark, "/root/testdata/sf0.01", str(tmp_path), "ATP", "Hard", "logistic")
    assert 0 < metrics["auc"] < 1
    _, notes = sinks.load_model(sinks.model_folder(str(tmp_path), "ATP", "Hard", "logistic", "v1"))
    assert notes["metadata"]["tour"] == "ATP" and notes["metrics"]["n"] == metrics["n"]
