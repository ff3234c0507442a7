import datetime as dt
import random

import pytest

from rallygrid.operators.as_known import as_known_at

T0 = dt.datetime(2020, 1, 1)


def make(seed, n, players):
    rng = random.Random(seed)
    who = lambda: rng.choice(players)
    versions, events = [], []
    for i in range(n):
        day = T0.date() + dt.timedelta(days=rng.randrange(40))
        rec = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=rng.randrange(-24, 24 * 15))
        versions.append((who(), day, rec, i // 2, float(i), "v"))
        events.append((i, who(), T0 + dt.timedelta(hours=rng.randrange(24 * 45)), "e"))
    versions += [(None, T0.date(), T0, 1, 1.0, "v"), ("a", None, T0, 1, 1.0, "v"), ("a", T0.date(), None, 1, 1.0, "v")]
    events += [(-1, None, T0, "e"), (-2, "a", None, "e"), events[0]]
    return versions, events


def brute(versions, events):
    out = []
    for e, p, t, _ in events:
        if p is None or t is None:
            continue
        ok = [v for v in versions if v[0] == p and v[1] and v[2] and v[1] < t.date() and v[2] <= t]
        if ok:
            b = max(ok, key=lambda v: (v[1], v[2], v[3]))
            out.append((e, p, b[3]))
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [50_000, 15])
@pytest.mark.parametrize("players", [["a"], ["a"] * 20 + list("bcdef")])
def test_against_brute_force(spark, shard_rows, players):
    versions, events = make(len(players), 150, players)
    v = spark.createDataFrame(versions, "entity string, valid_on date, recorded_at timestamp, version_id long, at double, shard string")
    e = spark.createDataFrame(events, "event_id long, entity string, at timestamp, version string")
    out = as_known_at(e, v.drop("at", "shard"), shard_rows)
    assert sorted((r.event_id, r.entity, r.version_id) for r in out.collect()) == brute(versions, events)
    # Payload columns with clashing names.
    both = as_known_at(e, v, shard_rows)
    assert {"at_version", "shard"} <= set(both.columns) and both.count() == out.count()


def test_empty(spark):
    versions, events = make(1, 5, ["a"])
    v = spark.createDataFrame(versions, "entity string, valid_on date, recorded_at timestamp, version_id long, x double, y string")
    e = spark.createDataFrame(events, "event_id long, entity string, at timestamp, z string")
    assert as_known_at(e.limit(0), v).count() == 0
    assert as_known_at(e, v.limit(0)).count() == 0
