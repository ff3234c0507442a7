import math
import random

import numpy as np

from rallygrid.llm import paired_ranking
from rallygrid.llm.paired_ranking import normal_cdf, probit_ranking

CDF = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))


def dense(games, ridge=1.0):
    """Newton's method with dense matrices."""
    items = sorted({x for g in games for x in g})
    at = {x: i for i, x in enumerate(items)}
    d = np.zeros((len(games), len(items)))
    for k, (w, l) in enumerate(games):
        d[k, at[w]], d[k, at[l]] = 1, -1
    s = np.zeros(len(items))
    for _ in range(100):
        eta = d @ s
        p, phi = CDF(eta), np.exp(-eta**2 / 2) / math.sqrt(2 * math.pi)
        fisher = d.T @ (d * (phi**2 / (p * (1 - p)))[:, None]) + ridge * np.eye(len(items))
        step = np.linalg.solve(fisher, d.T @ (phi / p) - ridge * s)
        s += step
        if abs(step).max() < 1e-10:
            break
    return {x: (s[at[x]], math.sqrt(np.linalg.inv(fisher)[at[x], at[x]])) for x in items}


def test_normal_cdf(spark):
    df = spark.range(-60, 61).selectExpr("id / 10.0D as x")
    for r in df.select("x", normal_cdf(df.x).alias("p")).collect():
        assert abs(r.p / CDF(r.x) - 1) < 1e-6


def test_against_dense_newton(spark):
    rng = random.Random(8)
    skill = {f"p{i}": rng.gauss(0, 1) for i in range(25)}
    rows = []
    for scope in ("all", "clay"):
        for _ in range(300 if scope == "all" else 80):
            a, b = rng.sample(sorted(skill), 2) if rng.random() < 0.7 else ("p0", rng.choice(sorted(skill)[1:]))
            rows.append((scope, a, b, 0) if rng.random() < CDF(skill[a] - skill[b]) else (scope, b, a, 0))
    rows += [("all", "new", "p3", 0)]  # one game, won
    bad = [(None, "p1", "p2", 0), ("all", None, "p1", 0), ("all", "p1", None, 0), ("all", "p1", "p1", 0)]
    df = spark.createDataFrame(rows + bad, "scope string, winner string, loser string, n int")
    out = probit_ranking(df).collect()
    for scope in ("all", "clay"):
        want = dense([(w, l) for s, w, l, _ in rows if s == scope])
        got = {r.item: r for r in out if r.scope == scope}
        assert set(got) == set(want)
        for item, (s, e) in want.items():
            assert abs(got[item].strength - s) < 1e-5
            assert abs(got[item].std_error / e - 1) < 1e-5
        assert [r.item for r in sorted(got.values(), key=lambda r: r.place)] == sorted(got, key=lambda x: (-got[x].strength, x))
        assert sum(r.n_won for r in got.values()) == sum(1 for r in rows if r[0] == scope)


def test_many_blocks(spark):
    """The rounds and steps across blocks reach the same strengths; errors then carry noise."""
    rng = random.Random(3)
    skill = {f"p{i}": rng.gauss(0, 0.7) for i in range(36)}
    rows = []
    for _ in range(900):
        a, b = rng.sample(sorted(skill), 2) if rng.random() < 0.7 else ("p0", rng.choice(sorted(skill)[1:]))
        rows.append(("all", a, b) if rng.random() < CDF(skill[a] - skill[b]) else ("all", b, a))
    rows += [("all", "q1", "q2")] * 40  # a pair by itself, one always winning
    want = dense([(w, l) for _, w, l in rows])
    got = {r.item: r for r in probit_ranking(spark.createDataFrame(rows, "scope string, winner string, loser string"), block=19, probes=16).collect()}
    for item, (s, e) in want.items():
        assert abs(got[item].strength - s) < 1e-5
        assert abs(got[item].std_error / e - 1) < 0.2


def test_empty(spark):
    assert probit_ranking(spark.createDataFrame([], "scope string, winner string, loser string")).count() == 0


def _games(items, n, seed):
    rng = random.Random(seed)
    skill = {f"p{i}": rng.gauss(0, 0.7) for i in range(items)}
    rows = []
    for _ in range(n):
        a, b = rng.sample(sorted(skill), 2)
        rows.append(("all", a, b) if rng.random() < CDF(skill[a] - skill[b]) else ("all", b, a))
    return rows


def test_scopes_of_many_blocks_are_solved_whole(spark, monkeypatch):
    """Without a job for each step; errors of parts over a block are estimated, of others exact."""
    def steps(*_):
        raise AssertionError("a scope that one task can hold went through distributed steps")

    monkeypatch.setattr(paired_ranking, "_Solver", steps)
    rows = _games(60, 3000, 4) + [("all", "q1", "q2")] * 40
    want = dense([(w, l) for _, w, l in rows])
    got = {r.item: r for r in probit_ranking(spark.createDataFrame(rows, "scope string, winner string, loser string"), block=19).collect()}
    assert set(got) == set(want)
    for item, (s, e) in want.items():
        assert abs(got[item].strength - s) < 1e-5
        assert abs(got[item].std_error / e - 1) < (1e-5 if item[0] == "q" else 0.2)
        assert got[item].n_won == sum(w == item for _, w, _ in rows) and got[item].n_comparisons == sum(item in r[1:] for r in rows)


def test_larger_scopes_go_in_steps(spark):
    """One scope over the limit and one under it, in one table."""
    rows = _games(36, 900, 3) + [("small", "x", "y"), ("small", "y", "z"), ("small", "x", "z")]
    got = {(r.scope, r.item): r for r in probit_ranking(spark.createDataFrame(rows, "scope string, winner string, loser string"), block=19, whole=3).collect()}
    for scope in ("all", "small"):
        want = dense([(w, l) for s, w, l in rows if s == scope])
        for item, (s, e) in want.items():
            assert abs(got[scope, item].strength - s) < 1e-5
            assert abs(got[scope, item].std_error / e - 1) < 0.2
    assert len(got) == 39
