import json

from pyspark.sql import functions as F

from rallygrid.operators.nested_records import interval_nodes, link_to_container, read_body, typed_table, walk

FIXTURES = [{"odds": {"k1": 1.005}, "player1": {"name": " A/B "}}, None, {"odds": None, "player1": {"id": 3}, "x": [[1, None], {}]}]


def test_bodies():
    text = json.dumps(FIXTURES)
    assert read_body(text) == FIXTURES
    assert read_body(json.dumps({"page": 1, "results": FIXTURES})) == FIXTURES
    assert read_body(json.dumps(text)) == FIXTURES
    assert read_body(json.dumps(json.dumps({"data": text}))) == FIXTURES
    for bad in (None, "", "nope", text[:-3], "7", '{"a": 1}', "[NaN]", "null", "[" * 100_000):
        assert read_body(bad) is None
    assert read_body("[]") == []


def test_labels_are_intervals():
    nodes = walk(9, FIXTURES)
    by_pre = {n[1]: n for n in nodes}
    assert sorted(by_pre) == list(range(len(nodes))) and sorted(n[2] for n in nodes) == list(range(len(nodes)))
    inside = [n for n in nodes if n[1] > by_pre[1][1] and n[2] < by_pre[1][2]]
    assert {n[4] for n in inside} == {"[].odds", "[].odds.k1", "[].player1", "[].player1.name"}
    deep = walk(1, json.loads("[" * 900 + "]" * 900))
    assert len(deep) == 900


def test_tables_and_links(spark):
    rows = [(1, json.dumps(FIXTURES), 0), (2, None, 0), (3, "{", 0), (None, "[]", 0), (4, "[]", 0)]
    df = spark.createDataFrame(rows, "payload_id long, body string, pre int")
    nodes = interval_nodes(df, "payload_id", F.col("body"))
    leaves = link_to_container(nodes, "[]", F.col("path").isin("[].odds.k1", "[].player1.name") & F.col("value").isNotNull())
    assert {(r.payload_id, r.parent_at, r.value) for r in leaves.collect()} == {(1, 1, "1.005"), (1, 1, " A/B ")}
    players = typed_table(nodes, "[].player1", {"id": "id", "name": "name"})
    assert {(r.match_pos, r.id, r.name) for r in players.collect()} == {(1, None, " A/B "), (3, "3", None)}
    assert interval_nodes(df.limit(0), "payload_id", F.col("body")).count() == 0
