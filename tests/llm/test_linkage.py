import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from rallygrid.llm.linkage import FIELDS, candidates, fit_em, link_records, map_bits, may_occur, name_pairs, occurring_bits, parse_name, parsed_names, prepare

COLS = "id long, first string, second string, oriented boolean, t timestamp, surface string, level string, n int"


def test_names():
    for text in ("Umbrafell S.", "S. Umbrafell", "UMBRAFELL S", "Umbrafell, Sovik", "Sovik Umbrafell", " Umbrafell  S.B. (CDN)", "van Umbrafell S."):
        assert parse_name(text)[:2] == ("umbrafell", "s"), text
    assert parse_name("Umbrafell")[:2] == ("umbrafell", "")
    assert parse_name("Zerto El Roséwick-Döruv") == ("rosewickdoruv", "z", "rosewick", "doruv")
    assert parse_name(None) == parse_name("  ") == ("", "", None, None)


def test_em_separates():
    rng = np.random.default_rng(0)
    sizes = list(FIELDS.values())
    good = [[s - 1] * 9 + [max(s - 2, 1)] for s in sizes]
    rows = [[rng.choice(g) for g in good] for _ in range(300)]
    rows += [[int(rng.integers(1, 3)), 0, int(rng.integers(0, 2)), 0, 1, 1, 0, 0] for _ in range(700)]
    share, logs = fit_em(np.array(rows), np.ones(len(rows)))
    assert 0.25 < share < 0.35
    assert all(x[-1] > 0 for x in logs)


def test_links(spark):
    rng = random.Random(1)
    syl = ["ba", "ro", "mi", "ke", "lun", "dor", "vas", "tel", "gri", "pol", "zan", "wex"]
    names = sorted({f"{rng.choice('ABCDEFGH')}x {''.join(rng.sample(syl, 4)).title()}" for _ in range(60)})
    t0 = dt.datetime(2020, 1, 1)
    matches, listings, truth = [], [], set()
    for i in range(600):
        a, b = rng.sample(names, 2)
        t = t0 + dt.timedelta(hours=rng.randrange(24 * 300))
        surface, level = rng.choice(["Hard", "Clay", "Grass"]), rng.choice(["250", "500", "C"])
        matches.append((i, a, b, True, t, surface, level, 0))
        if i % 3:
            short = lambda x: x.split()[1] + " " + x[0] + "."
            x, y = short(a), short(b)
            if i % 7 == 1:
                x = x[:2] + x[3:]  # a lost letter
            if i % 11 == 1:
                x, y = y, x
            shown = None if i % 31 == 1 else t + dt.timedelta(hours=rng.randrange(-30, 30))
            listings.append((10_000 + i, x, y, True, shown, None if i % 5 == 1 else surface, level, 0))
            truth.add((10_000 + i, i))
    for i in range(200):  # players that never met around that time
        a, b = rng.sample(names, 2)
        listings.append((20_000 + i, a, b, True, t0 + dt.timedelta(days=400 + i), "Hard", "250", 0))
    listings += [(30_000, None, "x", True, t0, None, None, 0), (30_001, "", "", True, None, None, None, 0), (None, names[0], names[1], True, t0, "Hard", "250", 0)]
    left, right = spark.createDataFrame(listings, COLS), spark.createDataFrame(matches, COLS)
    out = link_records(left, right).collect()
    got = {(r.left_id, r.right_id) for r in out}
    assert len({r.left_id for r in out}) == len(out) and all(0.5 <= r.confidence <= 1 for r in out)
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert link_records(left.limit(0), right).count() == 0 and link_records(left, right.limit(0)).count() == 0


def test_pairs_of_names_that_never_met_are_not_shuffled(spark):
    """A listing of many meanings: the map keeps the pairs that occur, and hardly any other."""
    rows = 2_000
    bits = map_bits(rows)
    spots = spark.range(rows).selectExpr("xxhash64(id) as spot")
    bit_map = occurring_bits(spots, bits)
    assert bit_map.selectExpr("explode(words) as w").selectExpr("sum(bit_count(w))").first()[0] <= rows
    asked = spark.range(100 * rows).selectExpr("id", "xxhash64(id) as spot")
    kept = {r.id for r in may_occur(asked, bit_map, bits).collect()}
    assert set(range(rows)) <= kept and len(kept) < 6 * rows


def test_listing_and_match_without_time(spark):
    t = dt.datetime(2020, 5, 5, 12)
    names = [(f"{c}x {c}orbanu{c}kel", f"{c}y {c}estrilo{c}mat") for c in "bcdfghjklm"]
    matches = [(i, *n, True, t if i % 3 else None, "Hard", "250", 0) for i, n in enumerate(names)]
    listings = [(100 + i, *n, True, t if i % 2 else None, "Hard", "250", 0) for i, n in enumerate(names)]
    left, right = spark.createDataFrame(listings, COLS), spark.createDataFrame(matches, COLS)
    parsed = parsed_names(left, right)
    l, r = prepare(left, parsed), prepare(right, parsed)
    forms = parsed.select("form", "sur", "head", "tail").distinct()
    meant = name_pairs(forms, forms).groupBy("l").agg(F.collect_list(F.struct("r", "agreement")).alias("may"))
    got = {(x.i, x.j) for x in candidates(l, r, meant).selectExpr("l.id as i", "r.id as j").collect()}
    assert got >= {(100 + i, i) for i in range(len(names))}


def test_names_alike_meet_once_and_are_paired_in_pieces(spark, monkeypatch):
    """Names that agree both ways round make one pair of records; meanings are paired over arrays of bounded size."""
    from rallygrid.llm import linkage

    t = dt.datetime(2020, 5, 5, 12)
    names = [f"morbanuke{c}" for c in "lmnprt"]
    rows = [(i, names[i % 6], names[(i + 1 + i // 6) % 6], True, t + dt.timedelta(days=i % 3), "Hard", "250", 0) for i in range(18)]
    df = spark.createDataFrame(rows, COLS)
    parsed = parsed_names(df)
    records, forms = prepare(df, parsed), parsed.select("form", "sur", "head", "tail").distinct()
    meant = name_pairs(forms, forms).groupBy("l").agg(F.collect_list(F.struct("r", "agreement")).alias("may"))
    assert candidates(records, records, meant).count() == 18 * 18
    whole = sorted(map(str, linkage.compare(candidates(records, records, meant)).collect()))
    assert len(whole) == 18 * 18  # all names are a slip apart
    monkeypatch.setattr(linkage, "PAIRS_HELD", 40)
    assert sorted(map(str, linkage.compare(candidates(records, records, meant)).collect())) == whole
