"""Structured Streaming versions: late and repeated deliveries, windowed counts, ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rallygrid.functions.formulas import BASE_RATING, TAU_SURFACE, decayed_py, expected_py


def distinct_deliveries(stream: DataFrame, keys: list[str], time: str, lateness: str = "30 days") -> DataFrame:
    """Repeated deliveries dropped within the watermark; later ones count as new rows."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 day", lateness: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), by, "n"
    )


def _rate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, values, days = state.get if state.exists else ([], [], [])
    ratings, last = dict(zip(ids, values)), dict(zip(ids, days))
    out, seen = [], set()
    rows = pd.concat(list(frames)).sort_values(["at", "row_id"])
    for r in rows.itertuples(index=False):
        match = (r.tourney_id, r.match_num)
        if None not in match and match == match and match in seen:
            continue
        seen.add(match)
        day = int(r.at.timestamp() // 86400)
        idle = [max(day - last[p], 0) if p in last else -1 for p in (r.winner_id, r.loser_id)]
        w, l = (ratings.get(p, BASE_RATING) for p in (r.winner_id, r.loser_id))
        before = [decayed_py(x, days, TAU_SURFACE) for x, days in ((w, idle[0]), (l, idle[1]))]
        k = r.k * (2.0 if max(idle) > 180 else 1.5 if max(idle) > 70 else 1.0)
        gain = k * (1 - expected_py(*before))
        ratings[r.winner_id], ratings[r.loser_id] = w + gain, l - gain
        last[r.winner_id] = last[r.loser_id] = day
        out.append((r.row_id, key[0], *before))
    state.update((list(ratings), list(ratings.values()), [last[p] for p in ratings]))
    yield pd.DataFrame(out, columns=["row_id", "surface", "winner_elo", "loser_elo"])


def streaming_ratings(stream: DataFrame) -> DataFrame:
    """Ratings before each match, state per surface (a rating and a last day per player); rows of one
    batch are taken in order of time, batches in order of arrival; deliveries repeated within a
    batch count once. The fold is serial, so a surface is one task whose rows of a batch and
    players must fit its memory: bound the batches at the source. Needs ``row_id, tourney_id,
    match_num, surface, winner_id, loser_id, at`` and the base ``k``."""
    return stream.groupBy("surface").applyInPandasWithState(
        _rate,
        "row_id long, surface string, winner_elo double, loser_elo double",
        "ids array<string>, ratings array<double>, days array<long>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
