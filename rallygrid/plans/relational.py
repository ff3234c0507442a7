"""Queries on cleaning, joins, set operations, sampling and nested bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.functions.dates import date_int, eight_digits, float_date
from rallygrid.functions.text import blanked, canonical_name, last_initial, nulled, pair_key, quoted_last_initial
from rallygrid.operators.consolidate import append_new, keep_first
from rallygrid.operators.fuzzy import fuzzy_candidates
from rallygrid.operators.joins import backward_asof, shift_sweep
from rallygrid.operators.longform import unpivot_sides
from rallygrid.plans.base import MATCHES, matches
from rallygrid.session import table


def clean_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Dates and numbers coerced, texts blanked and nulled."""
    t = table(spark, d, "ongoing_tourneys")
    return t.select(
        "row_id",
        eight_digits(F.col("tourney_date")).alias("digits_day"),
        float_date(F.col("tourney_date")).alias("float_day"),
        date_int(eight_digits(F.col("tourney_date"))).alias("day_int"),
        F.col("winner_seed").try_cast("double").alias("seed"),
        blanked(F.col("winner_entry")).alias("entry_blank"),
        nulled(F.col("tourney_date")).alias("date_text"),
    )


def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How often each column holds a token that stands for nothing."""
    t = table(spark, d, "ongoing_tourneys")
    names = ("tourney_date", "score", "winner_seed", "winner_entry", "surface")
    stats = t.agg(*[F.sum(nulled(F.col(c)).isNull().cast("long")).alias(c) for c in names])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")


def tiebreak_regex(spark: SparkSession, d: str) -> DataFrame:
    """Tie-breaks in a score, by side."""
    s = F.coalesce("score", F.lit(""))
    return table(spark, d, "ongoing_tourneys").select(
        "row_id", F.regexp_count(s, F.lit(r"7-6\s?\(")).cast("int").alias("won"), F.regexp_count(s, F.lit(r"6-7\s?\(")).cast("int").alias("lost")
    )


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_matches").select(
        "match_id", last_initial(F.col("player_a")).alias("key_a"), last_initial(F.col("player_b"), "").alias("key_b"),
        canonical_name(F.col("player_a")).alias("canonical_a"), pair_key(last_initial(F.col("player_a"), ""), last_initial(F.col("player_b"), "")).alias("pair"),
    )


def quoted_name_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atp_odds").select(
        "odds_id", quoted_last_initial(F.col("Winner")).alias("winner_key"), quoted_last_initial(F.col("Loser")).alias("loser_key")
    )


_ROW = ("tourney_id", "match_num", "winner_id", "loser_id", "score", "row_id")


def consolidate_master(spark: SparkSession, d: str) -> DataFrame:
    """History (up to a day) plus the later deliveries whose (date, winner, loser, score) are new."""
    t = table(spark, d, "ongoing_tourneys").select("tourney_date", *_ROW, "loaded_at")
    old, new = t.filter("loaded_at < timestamp'2020-01-01'"), t.filter("loaded_at >= timestamp'2020-01-01'").drop("loaded_at")
    return append_new(old, new, ["tourney_date", "winner_id", "loser_id", "score"])


def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ongoing_tourneys").filter("tourney_id is not null and match_num is not null")
    return keep_first(rows, ["tourney_id", "match_num"], [F.col("loaded_at"), F.col("row_id")], ["row_id", "winner_id", "loser_id"])


def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Names to ids on both sides. Two names may stand for several ids: rows fan out. The
    lookup is small (one row per player) and left to the planner to broadcast by its size."""
    lookup = table(spark, d, "player_elo_history").select(F.explode(F.array("winner_id", "loser_id")).alias("id")).distinct()
    names = table(spark, d, "analytics_player_matches").groupBy("player_id").agg(F.max("player").alias("player")).join(lookup, F.col("player_id") == F.col("id"), "left_semi")
    a = names.select(F.col("player").alias("player_a"), F.col("player_id").alias("found_a"))
    b = names.select(F.col("player").alias("player_b"), F.col("player_id").alias("found_b"))
    return table(spark, d, "training_matches").select("match_id", "player_a", "player_b").join(a, "player_a", "left").join(b, "player_b", "left").select("match_id", "found_a", "found_b")


def _odds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atp_odds").select(
        "odds_id", F.to_date("Date").alias("day"), F.lower(F.trim("pair_key")).alias("pair"), "Winner", "AvgW", "AvgL"
    )


def _training(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_matches").select(
        "match_id", F.to_date("match_date").alias("day"), F.lower(F.trim("pair_key")).alias("pair"), "player_a", "target"
    )


def semi_join_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of training rows whose pair has any quote, per year."""
    t = _training(spark, d).filter("day is not null")
    hit = t.join(_odds(spark, d).select("pair").filter("pair is not null").distinct().withColumn("hit", F.lit(1)), "pair", "left")
    return hit.groupBy(F.year("day").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count("hit").alias("covered"))


def uncovered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _training(spark, d).filter("pair is not null").join(_odds(spark, d), "pair", "left_anti").select("match_id", "pair")


def date_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Training rows on days that have quotes."""
    return _training(spark, d).join(_odds(spark, d).select("day").distinct(), "day", "left_semi").select("match_id", "day")


def date_shift_sweep(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda df: df.filter("pair is not null and day is not null")
    return shift_sweep(clean(_training(spark, d)), clean(_odds(spark, d)), "day", ["pair"], (-2, -1, 0, 1, 2))


def exact_date_pair_join(spark: SparkSession, d: str) -> DataFrame:
    """Same day and pair; odds turned to the orientation of the row, probabilities without the
    margin."""
    j = _training(spark, d).join(_odds(spark, d), ["day", "pair"])
    a_is_winner = F.col("target") == 1
    odds_a, odds_b = F.when(a_is_winner, F.col("AvgW")).otherwise(F.col("AvgL")), F.when(a_is_winner, F.col("AvgL")).otherwise(F.col("AvgW"))
    raw_a, raw_b = F.try_divide(F.lit(1.0), odds_a), F.try_divide(F.lit(1.0), odds_b)
    return j.select("match_id", "odds_id", odds_a.alias("odds_a"), odds_b.alias("odds_b"), F.round(F.try_divide(raw_a, raw_a + raw_b), 6).alias("market_a"))


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ongoing_tourneys")
    return t.select(F.col("winner_id").alias("id")).intersect(t.select(F.col("loser_id").alias("id")))


def set_except(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ongoing_tourneys")
    return t.select(F.col("loser_id").alias("id")).subtract(t.select(F.col("winner_id").alias("id")))


def set_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ongoing_tourneys")
    return t.select(F.explode(F.array("winner_id", "loser_id")).alias("id")).distinct()


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """For the players of the second bookmaker: the most similar names of the first."""
    both = lambda t: table(spark, d, t).select(F.explode(F.array("Winner", "Loser")).alias("name"))
    left = both("bookmaker_listings").select(canonical_name(F.col("name")).alias("name"))
    right = both("atp_odds").select(canonical_name(F.col("name")).alias("name"))
    out = fuzzy_candidates(left, right)
    return out.select("name", "candidate", F.round("ratio", 6).alias("ratio"), "place")


def inner_orientation_join(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with the ratings of the day, either orientation in a single join."""
    side = lambda a, b: {"player_a_id": f"{a}_id", "player_b_id": f"{b}_id", "elo_a": f"{a}_elo_before", "elo_b": f"{b}_elo_before"}
    long = unpivot_sides(table(spark, d, "player_elo_history"), ["history_id", "match_date"], [side("winner", "loser"), side("loser", "winner")])
    t = table(spark, d, "training_matches").select("match_id", "player_a_id", "player_b_id", F.to_date("match_date").alias("match_date"))
    return t.join(long, ["player_a_id", "player_b_id", "match_date"]).select("match_id", "history_id", "elo_a", "elo_b", F.round(F.col("elo_a") - F.col("elo_b"), 6).alias("delta_elo"))


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """The last rating row of player A at or before the day of each match."""
    side = lambda w: F.struct(F.col(f"{w}_id").alias("player_id"), F.col(f"{w}_elo_before").alias("elo"))
    states = table(spark, d, "player_elo_history").select("history_id", "match_date", F.explode(F.array(side("winner"), side("loser"))).alias("s")).select("s.player_id", F.col("match_date").alias("state_day"), "history_id", "s.elo")
    events = table(spark, d, "training_matches").filter("match_date is not null").select("match_id", F.col("player_a_id").alias("player_id"), F.to_date("match_date").alias("day"))
    return backward_asof(events, states, ["player_id"], "day", "state_day", "history_id", ["elo"]).select("match_id", "state_day", "history_id", "elo", F.greatest(F.lit(0), F.date_diff("day", "state_day")).alias("idle"))


def training_mirror(spark: SparkSession, d: str) -> DataFrame:
    side = lambda a, b, t: {"player": f"{a}_id", "opponent": f"{b}_id", "target": F.lit(t)}
    return unpivot_sides(matches(spark, d), ["row_id", "match_day"], [side("winner", "loser", 1), side("loser", "winner", 0)])


def daily_picks(spark: SparkSession, d: str) -> DataFrame:
    """Upcoming singles with odds of both sides: market probabilities, the better side, a tier."""
    m = table(spark, d, "upcoming_matches").select("payload_id", F.posexplode("matches").alias("i", "m")).filter("m is not null")
    rows = m.select(
        "payload_id", (F.col("i") + 1).cast("int").alias("match_pos"), F.col("m.player1.name").alias("a"), F.col("m.player2.name").alias("b"), F.col("m.odds.k1").alias("k1"), F.col("m.odds.k2").alias("k2"),
        F.col("m.player1.odd").try_cast("double").alias("o1"), F.col("m.player2.odd").try_cast("double").alias("o2"),
    ).filter("k1 > 0 and k2 > 0 and o1 > 0 and o2 > 0 and not contains(a, '/') and not contains(b, '/')")
    p = (1 / F.col("o1")) / (1 / F.col("o1") + 1 / F.col("o2"))
    q = (1 / F.col("k1")) / (1 / F.col("k1") + 1 / F.col("k2"))
    edge = F.round(p - q, 6)
    return rows.select(
        "payload_id", "match_pos", edge.alias("edge_a"), F.greatest(edge, -edge).alias("max_edge"), F.when(edge > -edge, F.col("a")).otherwise(F.col("b")).alias("recommendation"),
        F.when(F.abs(edge) >= 0.15, "HIGH").when(F.abs(edge) >= 0.10, "MEDIUM").when(F.abs(edge) >= 0.05, "LOW").otherwise("NONE").alias("tier"),
    )


def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows and winners per side of the cut."""
    part = F.when(F.col("match_date") < F.lit("2023-01-01").cast("timestamp"), "train").otherwise("test")
    return table(spark, d, "training_matches").filter("match_date is not null").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("target").cast("long").alias("wins"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_matches").groupBy("surface", "tourney_level").agg(F.count("*").alias("n"), F.countDistinct("player_a_id").alias("players"))


def tour_labels(spark: SparkSession, d: str) -> DataFrame:
    """Matches per tour label (level C is the challenger tour) and year."""
    tour = F.when(F.col("tourney_level") == "C", "CHALLENGER").otherwise("ATP")
    return matches(spark, d).groupBy(tour.alias("tour"), F.year("match_day").cast("long").alias("year")).agg(F.count("*").alias("n"))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Line items by flag and status: sums, means and counts in one pass."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n")
    )


def yearly_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders per nation and year: a two-step dimension join below the aggregate."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).groupBy("n_name", "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_ALL = (
    clean_coerce, null_tokens, tiebreak_regex, name_keys, quoted_name_keys, consolidate_master, dedupe_keep_first, lookup_join, semi_join_coverage, uncovered_pairs,
    date_overlap, date_shift_sweep, exact_date_pair_join, set_intersect, set_except, set_union, fuzzy_names, inner_orientation_join, asof_backward, training_mirror,
    daily_picks, temporal_split, value_counts, tour_labels, pricing_summary, yearly_orders,
)
QUERIES = {f.__name__: f for f in _ALL}

_TO = """t AS (SELECT match_id, CAST(match_date AS DATE) AS day, lower(trim(pair_key)) AS pair, player_a, target FROM training_matches),
o AS (SELECT odds_id, CAST("Date" AS DATE) AS day, lower(trim(pair_key)) AS pair, AvgW, AvgL FROM atp_odds)"""
_NULLED = "CASE WHEN trim({0}) IN ('', chr(9), 'nan', 'None') THEN NULL ELSE trim({0}) END"
_DIG = "CAST(try_strptime(nullif(regexp_extract(tourney_date, '\\d{8}'), ''), '%Y%m%d') AS DATE)"
_W = "string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')"
_LI = "lower(" + _W + "[-1]) || '{1}' || lower(left({0}, 1))"
_CANON = "trim(regexp_replace(translate(lower(coalesce({0}, '')), '-.''', '   '), '\\s+', ' ', 'g'))"

_ACCENTED, _CAPITALS = "áàâäéèêëíîïóôöúûüñçšžčåøý", "ABCDEFGHIJKLMNOPQRSTUVWXY"

ORACLES = {
    "clean_coerce": f"""SELECT row_id, {_DIG} AS digits_day, CAST(try_strptime(CAST(CAST(trunc(CASE WHEN isnan(try_cast(tourney_date AS DOUBLE)) OR try_cast(tourney_date AS DOUBLE) IS NULL THEN 0 ELSE try_cast(tourney_date AS DOUBLE) END) AS BIGINT) AS VARCHAR), '%Y%m%d') AS DATE) AS float_day,
 CAST(strftime({_DIG}, '%Y%m%d') AS INTEGER) AS day_int, try_cast(winner_seed AS DOUBLE) AS seed, coalesce(winner_entry, '') AS entry_blank, {_NULLED.format('tourney_date')} AS date_text FROM ongoing_tourneys""",
    "null_tokens": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n FROM ongoing_tourneys WHERE ({_NULLED.format(c)}) IS NULL" for c in ("tourney_date", "score", "winner_seed", "winner_entry", "surface")),
    "tiebreak_regex": r"SELECT row_id, CAST(len(regexp_extract_all(coalesce(score, ''), '7-6\s?\(')) AS INTEGER) AS won, CAST(len(regexp_extract_all(coalesce(score, ''), '6-7\s?\(')) AS INTEGER) AS lost FROM ongoing_tourneys",
    "name_keys": f"""WITH x AS (SELECT match_id, {_LI.format('player_a', '_')} AS key_a, {_LI.format('player_b', '')} AS key_b, {_LI.format('player_a', '')} AS ka, {_CANON.format('player_a')} AS canonical_a FROM training_matches)
SELECT match_id, key_a, key_b, canonical_a, CASE WHEN ka < key_b THEN ka || '|' || key_b ELSE key_b || '|' || ka END AS pair FROM x""",
    "quoted_name_keys": f"""WITH x AS (SELECT odds_id, {_W.format("replace(lower(\"Winner\"), '.', '')")} AS w, {_W.format("replace(lower(\"Loser\"), '.', '')")} AS l FROM atp_odds)
SELECT odds_id, CASE WHEN len(w) > 1 THEN w[1] || '_' || left(w[2], 1) END AS winner_key, CASE WHEN len(l) > 1 THEN l[1] || '_' || left(l[2], 1) END AS loser_key FROM x""",
    "consolidate_master": """WITH t AS (SELECT tourney_date, tourney_id, match_num, winner_id, loser_id, score, row_id, loaded_at FROM ongoing_tourneys), old AS (SELECT * FROM t WHERE loaded_at < TIMESTAMP '2020-01-01')
SELECT * FROM old UNION ALL SELECT tourney_date, tourney_id, match_num, winner_id, loser_id, score, row_id, NULL FROM t WHERE loaded_at >= TIMESTAMP '2020-01-01' AND NOT EXISTS (SELECT 1 FROM old WHERE old.tourney_date = t.tourney_date AND old.winner_id = t.winner_id AND old.loser_id = t.loser_id AND old.score = t.score)""",
    "dedupe_keep_first": "SELECT tourney_id, match_num, row_id, winner_id, loser_id FROM (SELECT *, row_number() OVER (PARTITION BY tourney_id, match_num ORDER BY loaded_at, row_id) AS rn FROM ongoing_tourneys WHERE tourney_id IS NOT NULL AND match_num IS NOT NULL) WHERE rn = 1",
    "lookup_join": """WITH ids AS (SELECT DISTINCT unnest([winner_id, loser_id]) AS id FROM player_elo_history), n AS (SELECT player_id, max(player) AS player FROM analytics_player_matches GROUP BY 1 HAVING player_id IN (SELECT id FROM ids))
SELECT match_id, a.player_id AS found_a, b.player_id AS found_b FROM training_matches t LEFT JOIN n a ON a.player = t.player_a LEFT JOIN n b ON b.player = t.player_b""",
    "semi_join_coverage": f"WITH {_TO} SELECT CAST(year(day) AS BIGINT) AS year, count(*) AS n, count(CASE WHEN pair IN (SELECT pair FROM o WHERE pair IS NOT NULL) THEN 1 END) AS covered FROM t WHERE day IS NOT NULL GROUP BY 1",
    "uncovered_pairs": f"WITH {_TO} SELECT match_id, pair FROM t WHERE pair IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.pair = t.pair)",
    "date_overlap": f"WITH {_TO} SELECT match_id, day FROM t WHERE EXISTS (SELECT 1 FROM o WHERE o.day = t.day)",
    "date_shift_sweep": f"WITH {_TO}, l AS (SELECT DISTINCT pair, day FROM t WHERE pair IS NOT NULL AND day IS NOT NULL), r AS (SELECT DISTINCT pair, day FROM o WHERE pair IS NOT NULL AND day IS NOT NULL) SELECT CAST(s AS INTEGER) AS shift, count(*) AS overlap FROM l, (VALUES (-2), (-1), (0), (1), (2)) v(s) WHERE EXISTS (SELECT 1 FROM r WHERE r.pair = l.pair AND r.day = l.day + CAST(s AS INTEGER)) GROUP BY s",
    "exact_date_pair_join": f"""WITH {_TO}, j AS (SELECT match_id, odds_id, CASE WHEN target = 1 THEN AvgW ELSE AvgL END AS odds_a, CASE WHEN target = 1 THEN AvgL ELSE AvgW END AS odds_b FROM t JOIN o USING (day, pair))
SELECT match_id, odds_id, odds_a, odds_b, round((1/odds_a)/(1/odds_a + 1/odds_b), 6) AS market_a FROM j""",
    "set_intersect": "SELECT winner_id AS id FROM ongoing_tourneys INTERSECT SELECT loser_id FROM ongoing_tourneys",
    "set_except": "SELECT loser_id AS id FROM ongoing_tourneys EXCEPT SELECT winner_id FROM ongoing_tourneys",
    "set_union": "SELECT winner_id AS id FROM ongoing_tourneys UNION SELECT loser_id FROM ongoing_tourneys",
    # The engine's distance counts bytes: accented letters, which lower-case names don't share with
    # capitals, stand as capitals while distances are taken.
    "fuzzy_names": f"""WITH l AS (SELECT DISTINCT name FROM (SELECT {_CANON.format('x')} AS name FROM (SELECT unnest(["Winner", "Loser"]) AS x FROM bookmaker_listings)) WHERE name <> ''),
r AS (SELECT DISTINCT name FROM (SELECT {_CANON.format('x')} AS name FROM (SELECT unnest(["Winner", "Loser"]) AS x FROM atp_odds)) WHERE name <> ''),
p AS (SELECT l.name, r.name AS candidate, 1 - levenshtein(translate(l.name, '{_ACCENTED}', '{_CAPITALS}'), translate(r.name, '{_ACCENTED}', '{_CAPITALS}')) / greatest(length(l.name), length(r.name)) AS ratio
 FROM l JOIN r ON abs(length(l.name) - length(r.name)) <= 0.25 * greatest(length(l.name), length(r.name)))
SELECT name, candidate, round(ratio, 6) AS ratio, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, candidate) AS place FROM p WHERE ratio >= 0.75) WHERE place <= 3""",
    "inner_orientation_join": """WITH e AS (SELECT history_id, match_date, winner_id AS a, loser_id AS b, winner_elo_before AS elo_a, loser_elo_before AS elo_b FROM player_elo_history UNION ALL SELECT history_id, match_date, loser_id, winner_id, loser_elo_before, winner_elo_before FROM player_elo_history)
SELECT match_id, history_id, elo_a, elo_b, round(elo_a - elo_b, 6) AS delta_elo FROM training_matches t JOIN e ON e.a = t.player_a_id AND e.b = t.player_b_id AND e.match_date = CAST(t.match_date AS DATE)""",
    "asof_backward": """WITH s AS (SELECT history_id, match_date AS state_day, winner_id AS p, winner_elo_before AS elo FROM player_elo_history UNION ALL SELECT history_id, match_date, loser_id, loser_elo_before FROM player_elo_history),
x AS (SELECT match_id, CAST(match_date AS DATE) AS day, state_day, history_id, elo, row_number() OVER (PARTITION BY match_id ORDER BY state_day DESC, history_id DESC) AS rn FROM training_matches t LEFT JOIN s ON s.p = t.player_a_id AND s.state_day <= CAST(t.match_date AS DATE) WHERE t.match_date IS NOT NULL)
SELECT match_id, state_day, history_id, elo, CAST(greatest(0, date_diff('day', state_day, day)) AS INTEGER) AS idle FROM x WHERE rn = 1""",
    "training_mirror": f"WITH {MATCHES} SELECT row_id, match_day, winner_id AS player, loser_id AS opponent, 1 AS target FROM matches UNION ALL SELECT row_id, match_day, loser_id, winner_id, 0 FROM matches",
    "daily_picks": """WITH m AS (SELECT payload_id, generate_subscripts(matches, 1) AS match_pos, unnest(matches) AS m FROM upcoming_matches),
r AS (SELECT payload_id, CAST(match_pos AS INTEGER) AS match_pos, m.player1.name AS a, m.player2.name AS b, m.odds.k1 AS k1, m.odds.k2 AS k2, try_cast(m.player1.odd AS DOUBLE) AS o1, try_cast(m.player2.odd AS DOUBLE) AS o2 FROM m WHERE m IS NOT NULL),
e AS (SELECT *, round((1/o1)/(1/o1+1/o2) - (1/k1)/(1/k1+1/k2), 6) AS edge FROM r WHERE k1 > 0 AND k2 > 0 AND o1 > 0 AND o2 > 0 AND NOT contains(a, '/') AND NOT contains(b, '/'))
SELECT payload_id, match_pos, edge AS edge_a, greatest(edge, -edge) AS max_edge, CASE WHEN edge > -edge THEN a ELSE b END AS recommendation,
 CASE WHEN abs(edge) >= 0.15 THEN 'HIGH' WHEN abs(edge) >= 0.10 THEN 'MEDIUM' WHEN abs(edge) >= 0.05 THEN 'LOW' ELSE 'NONE' END AS tier FROM e""",
    "temporal_split": "SELECT CASE WHEN match_date < TIMESTAMP '2023-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(target) AS BIGINT) AS wins FROM training_matches WHERE match_date IS NOT NULL GROUP BY 1",
    "value_counts": "SELECT surface, tourney_level, count(*) AS n, count(DISTINCT player_a_id) AS players FROM training_matches GROUP BY ALL",
    "tour_labels": f"WITH {MATCHES} SELECT CASE WHEN tourney_level = 'C' THEN 'CHALLENGER' ELSE 'ATP' END AS tour, CAST(year(match_day) AS BIGINT) AS year, count(*) AS n FROM matches GROUP BY ALL",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY ALL",
    "yearly_orders": "SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
}
