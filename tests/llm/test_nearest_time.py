import datetime as dt
import random

import pytest

from rallygrid.llm.nearest_time import nearest_in_time

T0 = dt.datetime(1970, 1, 3)  # times on both sides of the epoch
TOL = 3 * 3600


def brute(left, right):
    out = []
    for i, e, t, *_ in left:
        ok = [(abs((t - u).total_seconds()), j) for j, f, u, *_ in right if None not in (j, f, u) and e == f] if t and e else []
        ok = [x for x in ok if x[0] <= TOL]
        if ok and i is not None:
            out.append((i, min(ok)[1]))
    return sorted(out)


@pytest.mark.parametrize("keys", ["a", "aaaaaaaabcd"])
@pytest.mark.parametrize("bucket", [None, 3_600_000_000])
def test_against_brute_force(spark, keys, bucket):
    rng = random.Random(11)
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(-6000, 6000))
    left = [(i, rng.choice(keys), at(), 0) for i in range(150)]
    right = [(1000 - i, rng.choice(keys), at(), 0) for i in range(150)]
    # Exactly at the tolerance, one beyond it, ties before and after, copies, nulls.
    left += [(500, "x", T0, 0), (501, "y", T0, 0), (502, "z", T0, 0), (503, None, T0, 0), (504, "x", None, 0), (None, "x", T0, 0), left[0]]
    s = lambda n: T0 + dt.timedelta(seconds=n)
    right += [(1, "x", s(TOL), 0), (2, "y", s(TOL + 1), 0), (9, "z", s(-60), 0), (8, "z", s(60), 0), (7, "z", s(60), 0), (None, "z", T0, 0), (3, None, T0, 0), (4, "x", None, 0)]
    right += right[:3]
    cols = "id long, entity string, t timestamp, bucket int"
    out = nearest_in_time(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), TOL * 1_000_000, 40, bucket)
    assert sorted(map(tuple, out.collect())) == brute(left, right)


def test_empty(spark):
    cols = "id long, entity string, t timestamp"
    some = spark.createDataFrame([(1, "a", T0)], cols)
    assert nearest_in_time(some, some.limit(0), 10).count() == 0
    assert nearest_in_time(some.limit(0), some, 10).count() == 0
