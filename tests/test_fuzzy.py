import random

from pyspark.sql import functions as F

from rallygrid.operators.fuzzy import fuzzy_candidates
from rallygrid.plans.relational import fuzzy_names

SF = "/root/testdata/sf0.001"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _ratio(a, b):
    return 1 - _distance(a, b) / max(len(a), len(b))


def _names():
    rng = random.Random(5)
    out = {"i golelhest gweegnask", "golelhest gweegnask i", "a", "ab", "abé", "é"}
    for _ in range(40):
        base = "".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(3, 16)))
        out |= {f"x {base}", f"{base} x", base}
        for _ in range(4):
            x = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
            out.add("".join(x))
    return sorted(out - {""})


def test_no_pair_is_lost(spark):
    names = _names()
    left, right = names[::2], names[1::2]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    for least in (0.75, 0.6):
        got = fuzzy_candidates(frame(left), frame(right), least, len(names)).collect()
        want = {(a, b) for a in left for b in right if _ratio(a, b) >= least}
        assert {(r.name, r.candidate) for r in got} == want and len(got) == len(want)


def test_initial_first_and_last(spark):
    frame = lambda n: spark.createDataFrame([(n,)], "name string")
    got = fuzzy_candidates(frame("i golelhest gweegnask"), frame("golelhest gweegnask i")).collect()
    assert [(r.candidate, round(r.ratio, 2)) for r in got] == [("golelhest gweegnask i", 0.81)]


def test_winners_are_searched_too(spark):
    from rallygrid.functions.text import canonical_name

    frame = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").select(F.explode(F.array("Winner", "Loser")).alias("n")).select(canonical_name(F.col("n")).alias("name"))
    left, right = ({r.name for r in frame(t).distinct().collect() if r.name} for t in ("bookmaker_listings", "atp_odds"))
    want = {a for a in left if any(_ratio(a, b) >= 0.75 for b in right if abs(len(a) - len(b)) < 9)}
    assert {r.name for r in fuzzy_names(spark, SF).collect()} == want
