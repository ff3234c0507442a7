"""The sequential rating fold, overall and per surface.

What depends on the schedule only (idle days, K) is computed by windows beforehand; the fold
gets ids, days and K. It is serial by nature: the schedule is written once, partitioned by chunks of
bounded size along time, and each chunk is read alone and folded by one task per scope with the
ratings the chunk before left, so memory is bounded by a chunk and the ratings of a scope, and
scopes run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallygrid.functions.formulas import BASE_RATING, decayed_py, expected_py
from rallygrid.session import StepTables, cut_lineage

CHUNK_ROWS = 1_000_000
_OUT = "scope string, seq long, item string, w_before double, l_before double, w_stored double, l_stored double, rating double"


def _fold(tau: float):
    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        ratings = dict(zip(state["item"], state["rating"]))
        rows = rows.sort_values("seq")
        scope = rows["scope"].iloc[0] if len(rows) else (state["scope"].iloc[0] if len(state) else "")
        games: list[tuple[float, float, float, float]] = []
        for w, l, wd, ld, k in zip(rows["w"], rows["l"], rows["wd"], rows["ld"], rows["k"]):
            sw, sl = ratings.get(w, BASE_RATING), ratings.get(l, BASE_RATING)
            ew, el = decayed_py(sw, wd, tau), decayed_py(sl, ld, tau)
            gain = k * (1.0 - expected_py(ew, el))
            ratings[w], ratings[l] = sw + gain, sl - gain
            games.append((ew, el, sw, sl))
        played = pd.DataFrame(games, columns=["w_before", "l_before", "w_stored", "l_stored"], index=rows.index)
        played["seq"] = rows["seq"]
        after = pd.DataFrame({"item": list(ratings), "rating": list(ratings.values())})
        out = pd.concat([played, after], ignore_index=True)
        out["scope"] = scope
        out["seq"] = out["seq"].astype("Int64") if len(out) else pd.Series(dtype="Int64")
        return out.reindex(columns=["scope", "seq", "item", "w_before", "l_before", "w_stored", "l_stored", "rating"])

    return run


def elo_fold(schedule: DataFrame, tau: float, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Ratings before each match and the final ratings.

    ``schedule``: ``scope, seq long`` (positions from 1 in a total order, each given once to a scope),
    ``w, l string, wd, ld int, k double``. Returns ``scope, seq, w_before, l_before, w_stored,
    l_stored`` (with and without the decay) and ``scope, item, rating``. Rows with a null
    scope or player are left out by the caller; an empty schedule gives empty results.
    """
    spark = schedule.sparkSession
    tables = StepTables(spark)
    chunk = F.floor(F.col("seq") / chunk_rows).cast("int")
    kept = tables.cut(schedule.select("scope", "seq", "w", "l", "wd", "ld", "k", chunk.alias("chunk")), partition_by="chunk", keep=True)
    last = kept.agg(F.max("chunk")).first()[0]
    state = spark.createDataFrame([], "scope string, item string, rating double")
    done = None
    for at in range(0 if last is None else last + 1):
        rows = kept.filter(F.col("chunk") == at).drop("chunk")  # reads one folder
        out = cut_lineage(rows.groupBy("scope").cogroup(state.groupBy("scope")).applyInPandas(_fold(tau), _OUT))
        games = out.filter("item is null").select("scope", "seq", "w_before", "l_before", "w_stored", "l_stored")
        done = games if done is None else done.unionByName(games)
        state = tables.cut(out.filter("item is not null").select("scope", "item", "rating"))
    final = cut_lineage(state)
    tables.close()
    if done is None:
        done = spark.createDataFrame([], "scope string, seq long, w_before double, l_before double, w_stored double, l_stored double")
    return done, final
