"""Probabilistic linkage of listings and matches that share no key.

Names are parsed once per distinct spelling, and compared once per pair of distinct forms: keys
that hold every pair within the tolerated misspellings (pieces of the name by the pigeonhole
principle, in several passes for edits, cut names and the halves of double names) propose
the pairs, and their level of agreement is kept in a table. One name of a pair of records may be two
letters off, the other a single slip. A listing then stands for the pairs of
right-hand names that its two names may mean, paired over arrays, and meets the records of such a pair of names within a
time bucket: equality of hashes, so blocks are as small as the matches of two players in two
weeks. Most of these pairs never met in that bucket, and their number grows with the square of the
names alike: they are dropped where they arise, by a bit map of the (pair, bucket) that occur, so what
is shuffled follows the pairs of records. Records without a time are blocked on the names alone, against the other side reduced to one row per distinct
(names, surface, level) with a count, which keeps the number of pairs linear.

Pairs are compared field by field on agreement levels; expectation-maximisation over the counts of
the agreement patterns (their number is bounded by the product of the level counts) gives the match
and non-match probabilities of every level, and with them the odds of each pair. As a listing has
at most one match, its candidates compete: the confidence of a pair is its odds over one plus
the odds of all candidates of the listing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallygrid.operators.fuzzy import piece_keys, place_keys
from rallygrid.session import StepTables, broadcast_if_small, cut_lineage

#: Times further apart than this are never the same occasion.
REACH_DAYS = 8
BUCKET_DAYS = 2 * REACH_DAYS
PART = 4
#: Level of names that are equal but for one slip; one name of a pair must reach it.
SLIP = 2
CONFIDENCE = 0.5
#: Bits of the map a row of the right side: so few of the keys that never occur pass by chance.
BITS = 32
#: The most bits of a map, as it is broadcast; beyond, more keys pass by chance.
MOST_BITS = 1 << 28
CHUNK_WORDS = 512

#: Particles of surnames, and the spellings of surfaces and levels.
PARTICLES = frozenset({"da", "de", "del", "der", "di", "dos", "du", "el", "la", "le", "van", "von"})
SURFACES = {
    "hard": "hard", "hardcourt": "hard", "h": "hard", "hd": "hard", "hc": "hard",
    "clay": "clay", "red clay": "clay", "cl": "clay",
    "grass": "grass", "lawn": "grass", "gr": "grass",
    "carpet": "carpet", "indoor carpet": "carpet", "cp": "carpet",
}
LEVELS = {
    "250": "250", "atp250": "250", "500": "500", "atp500": "500", "m": "m", "masters 1000": "m",
    "g": "g", "grand slam": "g", "c": "c", "challenger": "c", "f": "f", "itf": "f",
    "d": "d", "team": "d", "a": "a", "tour": "a",
}

#: Levels per field, best agreement last; 0 of the times stands for an unknown time. Names beyond any
#: misspelling (level 0) are not proposed at all.
FIELDS = {"name_1": 4, "initial_1": 3, "name_2": 4, "initial_2": 3, "order": 3, "time": 11, "surface": 3, "level": 3}


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def parse_name(name: str | None) -> tuple[str, str, str | None, str | None]:
    """Surname letters without particles and blanks, the initial of the given name, and the
    first and last part of a hyphenated surname (else None twice).

    Understands ``Surname I.``, ``I. Surname``, ``Surname, Given``, ``Given Surname``, a bare
    surname, several initials and a bracketed country; empty texts for nothing."""
    if not name:
        return "", "", None, None
    text = re.sub(r"\([^)]*\)?", " ", fold(name))
    given = ""
    if "," in text:
        text, _, rest = text.partition(",")
        rest_words = re.findall(r"[^\W\d_]+", rest)
        given = rest_words[0][0] if rest_words else ""
    words = re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", text.replace(".", " "))
    words = [w for w in words if w not in PARTICLES] or words
    long = [w for w in words if len(w) > 1]
    short = [w for w in words if len(w) == 1]
    if not long:
        return "".join(words), given, None, None
    if not given:
        if short:
            given = short[0]
        elif len(long) > 1:
            given, long = long[0][0], long[1:]
    parts = [re.sub(r"[\W_]", "", p) for p in "".join(long).split("-")]
    if len(parts) == 1:
        return parts[0], given, None, None
    return "".join(parts), given, parts[0], parts[-1]


def _parse_batches(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    seen: dict[str | None, tuple[str, str, str | None, str | None]] = {}
    for batch in names:
        if len(seen) > 500_000:
            seen.clear()
        out = []
        for n in batch:
            if n not in seen:
                seen[n] = parse_name(n)
            out.append(seen[n])
        yield pd.DataFrame(out, columns=["sur", "ini", "head", "tail"])


def _canon(column: Column, spellings: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(column)))


def parsed_names(*sides: DataFrame) -> DataFrame:
    """``name, form, sur, ini, head, tail`` of every distinct spelling; ``form`` is a hash of the surname."""
    parsed = F.pandas_udf(_parse_batches, "sur string, ini string, head string, tail string")
    names = None
    for df in sides:
        own = df.select(F.explode(F.array("first", "second")).alias("name")).filter("name is not null")
        names = own if names is None else names.unionByName(own)
    out = names.distinct().select("name", parsed("name").alias("p")).select("name", "p.*").filter("sur <> ''")
    blank = F.lit("")
    return out.withColumn("form", F.xxhash64("sur", F.coalesce("head", blank), F.coalesce("tail", blank)))


def prepare(df: DataFrame, names: DataFrame) -> DataFrame:
    """``id, first, second, oriented, t, surface, level`` -> forms and initials of both names, canonical fields."""
    out = df.filter("id is not null and first is not null and second is not null").select(
        "id", "first", "second", "oriented", F.col("t").cast("timestamp").alias("t"), _canon(F.col("surface"), SURFACES).alias("surface"), _canon(F.col("level"), LEVELS).alias("level")
    )
    for side, x in (("first", "a"), ("second", "b")):
        out = out.join(names.select(F.col("name").alias(side), F.col("form").alias(x), F.col("ini").alias(f"{x}_ini")), side).drop(side)
    return out


def _edits(m: Column) -> Column:
    """The most edits at which names, the longer of m letters, still agree in some level."""
    return F.least(m, F.lit(2))


def _words(forms: DataFrame, name: str) -> DataFrame:
    """A row per form and part: the whole surname and the halves of a double name."""
    return forms.select(F.col("form").alias(name), F.explode(F.array_compact(F.array("sur", "head", "tail"))).alias(f"{name}_x")).filter(f"{name}_x <> ''")


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, agreement``: forms of both sides that agree at least in the lowest level above 0.

    Two words within k edits share one of k + 1 pieces of the longer one, near its place; a word that
    is cut short shares its first letters. What is proposed is checked at once, and compared as a
    whole once per pair of forms."""
    l, r = _words(left, "l"), _words(right, "r")
    most = lambda n: F.length(n) + F.lit(2)
    start = lambda n: F.when(F.length(n) >= PART, F.array(F.concat(F.lit("^"), F.substring(n, 1, PART)))).otherwise(F.array().cast("array<string>"))
    # Few bytes but much work: a set number of partitions, which adaptive coalescing leaves alone.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = lambda df, keys: df.withColumn("key", F.explode(F.transform(keys, lambda k: F.xxhash64(k)))).repartition(parts, "key")
    near = (F.levenshtein("l_x", "r_x", 2) >= 0) | ((F.abs(F.length("l_x") - F.length("r_x")) <= PART) & (F.startswith("l_x", "r_x") | F.startswith("r_x", "l_x")))
    met = lambda a, b: a.join(b, "key").filter(near).select("l", "r")
    longer_l = met(keyed(l, F.concat(piece_keys(F.col("l_x"), _edits), start("l_x"))), keyed(r, F.concat(place_keys(F.col("r_x"), _edits, 0, most("r_x")), start("r_x"))))
    longer_r = met(keyed(l, place_keys(F.col("l_x"), _edits, 1, most("l_x"))), keyed(r, piece_keys(F.col("r_x"), _edits)))
    named = lambda df, n: df.select(F.col("form").alias(n), F.struct("sur", "head", "tail").alias(f"{n}n"))
    pairs = longer_l.unionByName(longer_r).distinct().join(named(left, "l"), "l").join(named(right, "r"), "r")
    return pairs.select("l", "r", _name_level("ln", "rn").alias("agreement")).filter("agreement > 0")


def candidates(listings: DataFrame, matches: DataFrame, names: DataFrame) -> DataFrame:
    """Blocked pairs ``l, r`` (records), once each, with the agreement of both names if the match has them the same way
    round (``names_same``) and the other way round (``names_swap``), null where they don't agree;
    ``r.n`` counts the matches it stands for. ``names``: ``l, may``, the pairs of ``name_pairs`` by left name."""
    day = F.floor(F.unix_seconds("t") / 86400)
    bucket = lambda d: F.floor(d / BUCKET_DAYS)
    fields = ("id", "a", "a_ini", "b", "b_ini", "oriented", "t", "surface", "level")
    # Meanings travel as lists and are paired over arrays, should the names be too many to broadcast.
    meant = listings
    for side, x in (("a", "1"), ("b", "2")):
        meant = meant.join(names.select(F.col("l").alias(side), F.col("may.r").alias(f"form_{x}"), F.col("may.agreement").cast("array<tinyint>").alias(f"level_{x}")), side)
    # The key stands for both names, so rows travel with the order of their hashes only.
    light = [c for c in fields if c not in ("a", "b")]

    def held(df: DataFrame) -> DataFrame:
        return df.select(F.struct(*light, "n").alias("r"), (F.col("a") <= F.col("b")).alias("r_up"), _pair_key("a", "b").alias("key"), "t")

    whole = matches.withColumn("n", F.lit(1).cast("long"))
    same = [c for c in fields if c not in ("id", "t")]
    reduced = lambda df: df.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("t", F.lit(None).cast("timestamp"))
    # Where a pair of names may meet: within reach in time (kind 0); a listing without a time meets all
    # matches (kind 1), and any timed listing the matches without (kind 2).
    place = lambda kind, at: F.xxhash64(F.lit(kind), at.cast("long"))
    timed, untimed, none = F.col("t").isNotNull(), F.col("t").isNull(), F.lit(0)
    near = F.transform(F.sequence(bucket(day - REACH_DAYS), bucket(day + REACH_DAYS)), lambda b: place(0, b))
    places = F.when(untimed, F.array(place(1, none))).otherwise(F.concat(near, F.array(place(2, none))))
    right, occurring = None, None
    for kind, rows, records, at in (
        (0, matches.filter(timed), whole.filter(timed), bucket(day)),
        (1, matches, reduced(matches), none),
        (2, matches.filter(untimed), reduced(matches.filter(untimed)), none),
    ):
        own = rows.select(_pair_key("a", "b").bitwiseXOR(place(kind, at)).alias("spot"))
        occurring = own if occurring is None else occurring.unionByName(own)
        part = held(records).select("r", "r_up", F.col("key").bitwiseXOR(place(kind, at)).alias("spot"), "key")
        right = part if right is None else right.unionByName(part)
    bits = map_bits(matches.count())
    sc = matches.sparkSession.sparkContext
    bit_map = sc.broadcast(np.concatenate([np.zeros(0, np.int64), *[np.array(r.words, np.int64) for r in occurring_bits(occurring, bits).orderBy("chunk").toLocalIterator()]]))  # MOST_BITS bits at most
    asked = meant.select(*light, "form_1", "level_1", "form_2", "level_2", places.alias("places"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in light], "key long, spot long, up tinyint, down tinyint"])
    asked = asked.mapInArrow(_meetings(bit_map, light), schema).select(F.struct(*light).alias("l"), "key", "spot", "up", "down")
    met = asked.join(right, ["spot", "key"])
    side = lambda c: F.when(F.col(c) >= 0, F.struct(F.shiftright(c, 2).alias("name_1"), F.col(c).bitwiseAND(F.lit(3)).alias("name_2")))
    up, down = side("up"), side("down")
    return met.select("l", "r", F.when(F.col("r_up"), up).otherwise(down).alias("names_same"), F.when(F.col("r_up"), down).otherwise(up).alias("names_swap"))


def _pair_key(x: str, y: str) -> Column:
    """Of two forms, whichever is first: hashes themselves, so their difference in bits is one."""
    return F.when(F.col(x) == F.col(y), F.col(x)).otherwise(F.col(x).bitwiseXOR(F.col(y)))


#: Pairs of meanings held at once, as long as one listing has no more.
PAIRS_HELD = 500_000


def _meetings(bit_map, light: list[str]):
    """Listings with the pairs of names they may mean -> ``*light, key, spot, up, down``: a row per listing, pair of
    names and place that may occur; ``up``/``down`` hold the agreement of both names (4 x first + second) if the first
    has the smaller or equal hash / the greater one, -1 where they don't agree so."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.offsets.to_numpy(zero_copy_only=False).astype(np.int64), column.values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bit_map.value
        bits = np.int64(64 * len(words))
        for batch in batches:
            (o1, r1), (o2, r2), (op, place) = (lists(batch[c]) for c in ("form_1", "form_2", "places"))
            n1, n2 = lists(batch["level_1"])[1], lists(batch["level_2"])[1]
            k1, k2 = np.diff(o1), np.diff(o2)
            upto = np.concatenate([[0], np.cumsum(k1 * k2)])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS_HELD, "right")) - 1)
                row = np.repeat(np.arange(start, end), (k1 * k2)[start:end])
                at = np.arange(len(row)) + upto[start] - upto[row]
                i, j = np.divmod(at, k2[row])
                i, j = i + o1[row], j + o2[row]
                keep = np.flatnonzero((n1[i] >= SLIP) | (n2[j] >= SLIP))
                row, i, j = row[keep], i[keep], j[keep]
                key = np.where(r1[i] == r2[j], r1[i], r1[i] ^ r2[j])
                found = []
                for p in range(int(np.diff(op)[start:end].max())):
                    there = slice(None) if np.diff(op)[start:end].min() > p else np.flatnonzero(op[row] + p < op[row + 1])
                    spot = key[there] ^ place[op[row[there]] + p]
                    bit = spot & (bits - 1)
                    hit = np.flatnonzero((words[bit >> 6] >> (bit & 63)) & 1)
                    found.append(((hit if isinstance(there, slice) else there[hit]), spot[hit]))
                hit, spot = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                row, i, j, key = row[hit], i[hit], j[hit], key[hit]
                order = np.lexsort((spot, key, row))
                row, i, j, key, spot = row[order], i[order], j[order], key[order], spot[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])])) if len(row) else np.zeros(0, np.int64)
                group = np.cumsum(np.bincount(first, minlength=len(row))) - 1
                both = (4 * n1[i] + n2[j]).astype(np.int8)
                up, down = np.full(len(first), -1, np.int8), np.full(len(first), -1, np.int8)
                rising = r1[i] <= r2[j]
                up[group[rising]], down[group[~rising]] = both[rising], both[~rising]
                taken = batch.select(light).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(x) for x in (key[first], spot[first], up, down)]], names=[*light, "key", "spot", "up", "down"])
                start = end

    return run


def map_bits(rows: int) -> int:
    """Bits of a map of so many rows: a power of two, a chunk at least."""
    return min(MOST_BITS, max(64 * CHUNK_WORDS, 1 << (BITS * rows).bit_length()))


def occurring_bits(spots: DataFrame, bits: int) -> DataFrame:
    """``chunk, words``: a map of ``bits`` bits with those of the hashes ``spot`` set. All words are there,
    so a word's place in its chunk is its number."""
    at = spots.select(F.pmod("spot", F.lit(bits)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("set"))
    every = spots.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
    words = words.unionByName(every).groupBy("word").agg(F.bit_or("set").alias("set"))
    chunk = F.floor(F.col("word") / CHUNK_WORDS).cast("long")
    return words.groupBy(chunk.alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x.set).alias("words"))


def may_occur(df: DataFrame, bit_map: DataFrame, bits: int) -> DataFrame:
    """Rows whose hash ``spot`` is in the map: all that occur, and few others. Rows don't move for it."""
    at = F.pmod("spot", F.lit(bits))
    chunk = F.floor(at / (64 * CHUNK_WORDS)).cast("long")
    near = df.withColumn("chunk", chunk).join(F.broadcast(bit_map), "chunk")  # MOST_BITS bits at most
    word = F.element_at("words", (F.pmod(F.shiftright(at, 6), F.lit(CHUNK_WORDS)) + 1).cast("int"))
    return near.filter(F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1).drop("spot", "chunk", "words")


def _name_level(x: str, y: str) -> Column:
    """Agreement of two parsed surnames (columns of ``parse_name``): 3 equal, 2 one slip, cut
    short or one part of a double name, 1 two slips, 0 beyond any misspelling."""
    c = F.col
    part = lambda n, k: c(f"{n}.sur") if k == "sur" else F.coalesce(c(f"{n}.{k}"), c(f"{n}.sur"))
    parts = F.greatest(
        *[_spelling(part(x, i), part(y, j)) for i, j in (("sur", "head"), ("sur", "tail"), ("head", "sur"), ("tail", "sur"))]
    )
    double = c(f"{x}.head").isNotNull() | c(f"{y}.head").isNotNull()
    whole = _spelling(c(f"{x}.sur"), c(f"{y}.sur"))
    return F.when((whole < SLIP) & double, F.greatest(whole, F.least(parts, F.lit(SLIP)))).otherwise(whole)


def _spelling(x: Column, y: Column) -> Column:
    d = F.levenshtein(x, y, 2)  # -1 beyond two edits
    d = F.when(d < 0, 99).otherwise(d)
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.when((d == 2) & (letters(x) == letters(y)), 1).otherwise(d)  # two letters changed places
    shorter = F.least(F.length(x), F.length(y))
    cut_short = (shorter >= PART) & (F.abs(F.length(x) - F.length(y)) <= PART) & (F.startswith(x, y) | F.startswith(y, x))
    return (
        F.when(x == y, 3)
        .when((d <= 1) | cut_short, SLIP)
        .when((d <= 2) & (shorter >= 6), 1)
        .otherwise(0)
    )


def _agreement(x: Column, y: Column) -> Column:
    """0 different, 1 unknown, 2 equal."""
    return F.when(F.coalesce(x, F.lit("")).eqNullSafe("") | F.coalesce(y, F.lit("")).eqNullSafe(""), 1).when(x == y, 2).otherwise(0)


def compare(pairs: DataFrame) -> DataFrame:
    """Agreement levels of all fields, with ids, ``n`` and the gap in hours, once per pair of records:
    names that agree both ways round count the better way."""
    c = F.col
    hours = (F.unix_seconds("l.t") - F.unix_seconds("r.t")) / 3600.0
    # A listing of exactly midnight gives a day only; it is compared by calendar days.
    day_only = F.date_trunc("day", c("l.t")) == c("l.t")
    days = F.abs(F.date_diff(F.to_date("l.t"), F.to_date("r.t")))
    time = (
        F.when(c("l.t").isNull() | c("r.t").isNull(), 0)
        .when(day_only, F.when(days == 0, 10).when(days == 1, 9).when(days <= 2, 8).when(days <= 5, 7).otherwise(1))
        .otherwise(
            F.when(F.abs(hours) <= 12, 6).when(F.abs(hours) <= 24, 5).when(F.abs(hours) <= 36, 4)
            .when(F.abs(hours) <= 72, 3).when(F.abs(hours) <= 144, 2).otherwise(1)
        )
    )
    def turned(names: str, swap: bool) -> Column:
        x, y = ("b", "a") if swap else ("a", "b")
        levels = {
            "name_1": c(f"{names}.name_1"),
            "initial_1": _agreement(c("l.a_ini"), c(f"r.{x}_ini")),
            "name_2": c(f"{names}.name_2"),
            "initial_2": _agreement(c("l.b_ini"), c(f"r.{y}_ini")),
            "order": F.when(~(c("l.oriented") & c("r.oriented")), 1).otherwise(0 if swap else 2),
            "time": time,
            "surface": _agreement(c("l.surface"), c("r.surface")),
            "level": _agreement(c("l.level"), c("r.level")),
        }
        return F.struct(*[v.cast("tinyint").alias(k) for k, v in levels.items()])

    sum_of = lambda n: c(f"{n}.name_1") + c(f"{n}.name_2")
    swap = c("names_same").isNull() | F.coalesce(sum_of("names_swap") > sum_of("names_same"), F.lit(False))
    best = F.when(swap, turned("names_swap", True)).otherwise(turned("names_same", False))
    rows = pairs.select(c("l.id").alias("left_id"), c("r.id").alias("right_id"), c("r.n").alias("n"), F.abs(hours).alias("gap"), best.alias("v"))
    return rows.select("left_id", "right_id", "n", "gap", "v.*")


def fit_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 2_000) -> tuple[float, list[np.ndarray]]:
    """Share of matches and log odds (match over non-match) of every level of every field.

    ``patterns``: one row of levels per distinct pattern. Starts from "agreement means match";
    probabilities are smoothed by half a count per level, so nothing becomes impossible. Raises if
    the rounds don't converge."""
    sizes = list(FIELDS.values())
    good = np.array([(patterns[:, k] / (s - 1)) for k, s in enumerate(sizes)])
    names = list(FIELDS)
    t = patterns[:, names.index("time")]
    good[names.index("time")] = np.select([t == 0, t == 1, t <= 3, t == 7], [0.5, 0.05, 0.4, 0.4], 0.95)
    key = good[[names.index(x) for x in ("name_1", "name_2")]].min(axis=0)
    w = np.clip(key * good.mean(axis=0) * 1.2 - 0.25, 0.01, 0.99)
    spelt = patterns[:, [names.index("name_1"), names.index("name_2")]].min(axis=1)
    w = np.where(spelt >= SLIP, w, 0.01)
    share, logs = 0.5, [np.zeros(s) for s in sizes]
    total = counts.sum()
    for _ in range(rounds):
        before = share
        share = float(np.clip((w * counts).sum() / total, 1e-6, 1 - 1e-6))
        for k, s in enumerate(sizes):
            m = np.bincount(patterns[:, k], w * counts, s) + 0.5
            u = np.bincount(patterns[:, k], (1 - w) * counts, s) + 0.5
            logs[k] = np.log(m / m.sum()) - np.log(u / u.sum())
        odds = np.log(share / (1 - share)) + sum(logs[k][patterns[:, k]] for k in range(len(sizes)))
        w = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if abs(share - before) < 1e-9:
            return share, logs
    raise RuntimeError(f"expectation-maximisation did not converge in {rounds} rounds")


def link_records(listings: DataFrame, matches: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``left_id long, right_id long, confidence double``: each listing with its match.

    Both sides: ``id, first, second, oriented, t, surface, level`` - two names, whether their
    order tells winner and loser, a time and two labels, all but the id nullable; other columns
    are ignored. Pairs of at least the given confidence are returned, at most one per listing
    (ties: the smaller gap in time, then the smaller id). Records without two names take no
    part; repeated matches share a listing's confidence; empty tables give no rows.
    """
    cols = ("id", "first", "second", "oriented", "t", "surface", "level")
    listings, matches = listings.select(*cols), matches.select(*cols)
    names, _ = broadcast_if_small(cut_lineage(parsed_names(listings, matches)))
    # Tables hold a row in a third of the bytes of a checkpoint.
    steps, kept = StepTables(listings.sparkSession), StepTables(listings.sparkSession)
    left, right = steps.cut(prepare(listings, names), keep=True), steps.cut(prepare(matches, names), keep=True)
    used = lambda df: names.join(df.select(F.explode(F.array("a", "b")).alias("form")).distinct(), "form", "left_semi").select("form", "sur", "head", "tail").distinct()
    forms = name_pairs(used(left), used(right)).groupBy("l").agg(F.collect_list(F.struct("r", "agreement")).alias("may"))  # names within two letters of one
    forms, _ = broadcast_if_small(steps.cut(forms, keep=True))
    scored = kept.cut(compare(candidates(left, right, forms)), keep=True)
    steps.close()
    seen = scored.groupBy(*FIELDS).agg(F.count("*").alias("pairs")).collect()
    if not seen:
        return listings.sparkSession.createDataFrame([], "left_id long, right_id long, confidence double")
    patterns = np.array([[r[f] for f in FIELDS] for r in seen], dtype=np.int64)
    share, logs = fit_em(patterns, np.array([float(r["pairs"]) for r in seen]))
    odds = F.lit(float(np.log(share / (1 - share))))
    for field, values in zip(FIELDS, logs):
        odds = odds + F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(field) + 1)
    odds = F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds)))
    rivals = Window.partitionBy("left_id")
    best = Window.partitionBy("left_id").orderBy(F.col("odds").desc(), F.col("gap").asc_nulls_last(), "right_id")
    return (
        scored.withColumn("odds", odds)
        .withColumn("rank", F.row_number().over(best))
        .withColumn("confidence", F.col("odds") / (1 + F.sum(F.col("odds") * F.col("n")).over(rivals)))
        .filter((F.col("rank") == 1) & (F.col("confidence") >= confidence))
        .select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), "confidence")
    )
