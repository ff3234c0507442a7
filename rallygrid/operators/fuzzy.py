"""Fuzzy candidates between two name lists, blocked without loss and ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def similarity(a, b):
    """1 - Levenshtein distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _start(i: Column, length: Column, k: Column) -> Column:
    """Where piece ``i`` of the ``k + 1`` pieces of a name starts, counted from 0."""
    return F.floor(i * length / (k + 1)).cast("int")


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _key(length: Column, i: Column, piece: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), i.cast("string"), piece)


def piece_keys(name: Column, edits: Callable[[Column], Column]) -> Column:
    """Keys of a name as the longer one of a pair: its pieces, one more than the edits that may
    part it from the other."""
    m = F.length(name)
    k = edits(m)
    end = lambda i: _start(i + 1, m, k)
    return F.transform(F.sequence(F.lit(0), k), lambda i: _key(m, i, F.substring(name, _start(i, m, k) + 1, end(i) - _start(i, m, k))))


def place_keys(name: Column, edits: Callable[[Column], Column], longer: int, most: Column) -> Column:
    """Keys of a name as the shorter one: for each length of the other (from ``longer`` letters more
    to ``most``), whatever stands where one of its pieces can have moved to."""
    n = F.length(name)

    def of_piece(m: Column, k: Column, i: Column) -> Column:
        start, size = _start(i, m, k), _start(i + 1, m, k) - _start(i, m, k)
        low = F.greatest(F.lit(0), (start - F.floor((k + m - n) / 2)).cast("int"))
        high = F.least(n - size, (start + F.floor((k - m + n) / 2)).cast("int"))
        return F.transform(_range(low, high), lambda at: _key(m, i, F.substring(name, at + 1, size)))

    def of_length(m: Column) -> Column:
        k = edits(m)
        return F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: of_piece(m, k, i)))

    return F.array_distinct(F.flatten(F.transform(_range(n + longer, most), of_length)))


def fuzzy_candidates(left: DataFrame, right: DataFrame, least: float = 0.75, top: int = 3) -> DataFrame:
    """``name, candidate, ratio, place``: for each distinct left ``name`` the ``top`` most
    similar distinct right ones of at least ``least`` (above 0).

    Blocking loses no pair. If the longer name has m letters, at most k = (1 - least) m edits part
    the two, so one of its k + 1 pieces stands unchanged in the shorter one. Where it moved by s
    letters, at least |s| edits lie before it and |d + s| behind, d being the difference of
    the lengths, so -(k + d) / 2 <= s <= (k - d) / 2. Both sides list these keys: an equi-join."""
    names = lambda df, n: df.select(F.col("name").alias(n)).filter("name is not null and name <> ''").distinct()
    l, r = names(left, "l"), names(right, "r")
    edits = lambda m: F.floor(m * F.lit(1 - least) + F.lit(1e-9)).cast("int")
    most = lambda name: F.floor(F.length(name) / F.lit(least) + F.lit(1e-9)).cast("int")
    met = lambda a, b: a.join(b, "key").select("l", "r")
    keyed = lambda df, keys: df.withColumn("key", F.explode(keys))
    pairs = met(keyed(l, piece_keys(F.col("l"), edits)), keyed(r, place_keys(F.col("r"), edits, 0, most("r")))).unionByName(
        met(keyed(l, place_keys(F.col("l"), edits, 1, most("l"))), keyed(r, piece_keys(F.col("r"), edits)))
    )
    ratio = similarity(F.col("l"), F.col("r"))
    w = Window.partitionBy("name").orderBy(F.col("ratio").desc(), "candidate")
    return (
        pairs.filter(ratio >= least)
        .distinct()
        .select(F.col("l").alias("name"), F.col("r").alias("candidate"), ratio.alias("ratio"))
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= top)
    )
