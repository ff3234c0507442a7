import datetime as dt
import random

from pyspark.sql import functions as F

from rallygrid.operators.trailing_totals import trailing_totals

D0 = dt.date(2021, 2, 20)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), D0 + dt.timedelta(days=rng.randrange(60)), rng.choice([None, 1, 2, 5]), "n") for _ in range(120)]
    rows += [(None, D0, 1, "n"), ("a", None, 1, "n"), ("c", D0, None, "n")]
    df = spark.createDataFrame(rows, "who string, d date, ace int, n string")
    out = {(r.who, r.day): r for r in trailing_totals(df, "who", F.col("d"), ["ace"], (7, 30)).collect()}
    clean = [r for r in rows if r[0] and r[1]]
    expected = 0
    for who in "abc":
        days = [r[1] for r in clean if r[0] == who]
        for k in range((max(days) - min(days)).days + 1):
            day = min(days) + dt.timedelta(days=k)
            expected += 1
            for p in (7, 30):
                near = [r for r in clean if r[0] == who and 0 <= (day - r[1]).days < p]
                known = [r[2] for r in near if r[2] is not None]
                got = out[who, day]
                assert got[f"events_{p}"] == len(near) and got[f"ace_sum_{p}"] == sum(known)
                assert got[f"ace_avg_{p}"] == (sum(known) / len(known) if known else None)
    assert len(out) == expected
    assert trailing_totals(df.limit(0), "who", F.col("d"), ["ace"]).count() == 0
