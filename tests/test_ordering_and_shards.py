import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rallygrid.functions.columns import drop_present, keep_present, numeric_columns, with_features
from rallygrid.functions.formulas import half_even
from rallygrid.operators.evaluate import auc, exact_quantiles
from rallygrid.operators.joins import backward_asof
from rallygrid.operators.ordering import first_known, global_row_number, join_with_suffixes, stratified_split


def test_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert keep_present(df, ["c", "z", "a"]).columns == ["c", "a"]
    assert drop_present(df, ["z", "b"]).columns == ["a", "c"]
    assert numeric_columns(df, without=["c"]) == ["a"]
    assert with_features(df, ["c", "q"], ["a"]).first() == (1, 2.0, None)


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(half_even(df.x, 2)).collect()] == [0.12, 0.38, -0.12, None]


def test_row_numbers(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7, F.lit(10)))
    got = [(r.k, r.id, r.seq) for r in global_row_number(df, [F.col("k"), F.col("id").desc()], "seq").collect()]
    want = sorted(got, key=lambda r: (r[0], -r[1]))
    assert [r[2] for r in want] == list(range(1000))
    assert global_row_number(df.limit(0), [F.col("id")]).count() == 0


def test_split_is_exact_in_every_class(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small") for i in range(5000)] + [(9999, "one")]
    out = stratified_split(spark.createDataFrame(rows, "id long, c string"), "c", "id")
    n = {(r.c, r.part): r["count"] for r in out.groupBy("c", "part").count().collect()}
    for c in ("big", "small", None):
        size = sum(1 for r in rows if r[1] == c)
        assert n[c, "train"] == int(size * 0.8) and n[c, "train"] + n[c, "test"] == size
    assert n["one", "test"] == 1 and out.columns == ["id", "c", "part"]


def test_suffixes_and_first_known(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, None, 6), (2, None, 7)], "k int, v string, t int")
    j = join_with_suffixes(a, a, ["k"])
    assert j.columns == ["k", "v_x", "t_x", "v_y", "t_y"] and j.count() == 5
    got = {r.k: (r.v, r.t) for r in first_known(a, ["k"], [-F.col("t")], ["v", "t"]).collect()}
    assert got == {1: ("x", 6), 2: (None, 7)}


@pytest.mark.parametrize("shard_rows", [50_000, 20])
def test_backward_asof_with_a_hot_key(spark, shard_rows):
    rng = random.Random(1)
    t0 = dt.datetime(2021, 1, 1)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    at = lambda: None if rng.random() < 0.05 else t0 + dt.timedelta(hours=rng.randrange(400))
    states = [(key(), at(), i, i * 1.0) for i in range(200)]
    events = [(i, key(), at()) for i in range(200)] + [(0, "hot", t0)]
    s = spark.createDataFrame(states, "k string, seen timestamp, tie long, v double")
    e = spark.createDataFrame(events, "id long, k string, at timestamp")
    got = sorted((r.id, str(r.k), str(r["at"]), r.tie) for r in backward_asof(e, s, ["k"], "at", "seen", "tie", ["v"], shard_rows).collect())
    want = []
    for i, k, t in events:
        ok = [x for x in states if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        want.append((i, str(k), str(t), max(ok, key=lambda x: (x[1], x[2]))[2] if ok else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or 0)) or sorted(map(str, got)) == sorted(map(str, want))


def test_quantiles_and_auc(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice([rng.gauss(0, 3), 1.5, -2.0]), rng.randrange(2)) for _ in range(500)] + [("x", None, 1), (None, 1.0, 1), ("lone", 4.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, y int")
    shares = (0.0, 0.1, 0.5, 0.77, 1.0)
    import numpy as np

    got = {r.g: r.q for r in exact_quantiles(df, "v", shares, ["g"]).collect()}
    for g in ("x", "y", "lone"):
        assert np.allclose(got[g], np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None], shares))
    assert set(got) == {"x", "y", "lone"}
    a = {r.g: r.auc for r in auc(df.filter("g is not null"), "y", "v", ["g"]).collect()}
    for g in ("x", "y"):
        p = [r[1] for r in rows if r[0] == g and r[1] is not None and r[2] == 1]
        n = [r[1] for r in rows if r[0] == g and r[1] is not None and r[2] == 0]
        assert abs(a[g] - sum((u > v) + 0.5 * (u == v) for u in p for v in n) / len(p) / len(n)) < 1e-9
    assert a["lone"] is None
