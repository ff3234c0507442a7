import datetime as dt
import random

import pytest

from rallygrid.functions.formulas import decayed_py, expected_py
from rallygrid.operators.elo import elo_fold
from rallygrid.operators.fuzzy import fuzzy_candidates
from rallygrid.operators.windows import before_date_last_n


def test_last_n_before_the_date(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(12)), rng.choice([None, 1, 4])) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, p string, d date, x int")
    out = {r.id: r for r in before_date_last_n(df, ["p"], "d", "id", ["x"], (3, 50)).collect()}
    for i, p, d, _ in rows:
        past = sorted((r[2], r[0], r[3]) for r in rows if r[1] == p and r[2] < d)
        assert out[i].history == len(past)
        for n in (3, 50):
            assert out[i][f"x_last{n}"] == (sum(v or 0 for *_, v in past[-n:]) if past else None)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 17])
def test_fold_in_chunks(spark, chunk_rows):
    rng = random.Random(7)
    rows = [("s" + str(i % 2), i, *rng.sample("abcdef", 2), rng.randrange(-1, 90), rng.randrange(-1, 200), 24.0) for i in range(120)]
    games, final = elo_fold(spark.createDataFrame(rows, "scope string, seq long, w string, l string, wd int, ld int, k double"), 730.0, chunk_rows)
    want, ratings = {}, {}
    for s, i, w, l, wd, ld, k in rows:
        x, y = ratings.get((s, w), 1500.0), ratings.get((s, l), 1500.0)
        ew, el = decayed_py(x, wd, 730.0), decayed_py(y, ld, 730.0)
        want[i] = (ew, el)
        ratings[s, w], ratings[s, l] = x + k * (1 - expected_py(ew, el)), y - k * (1 - expected_py(ew, el))
    assert {r.seq: (r.w_before, r.l_before) for r in games.collect()} == want
    assert {(r.scope, r.item): r.rating for r in final.collect()} == ratings


def test_empty_fold(spark):
    games, final = elo_fold(spark.createDataFrame([], "scope string, seq long, w string, l string, wd int, ld int, k double"), 730.0)
    assert games.count() == 0 and final.count() == 0


def test_fuzzy_against_all_pairs(spark):
    names = ["moravvold p", "moravold p", "umbrafell s", "umbrafel s", "zalimond w", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.candidate) for r in fuzzy_candidates(df, df, 0.75, 3).collect()}
    assert got == {(a, a) for a in names if a} | {("moravvold p", "moravold p"), ("moravold p", "moravvold p"), ("umbrafell s", "umbrafel s"), ("umbrafel s", "umbrafell s")}
