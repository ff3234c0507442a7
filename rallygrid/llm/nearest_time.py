"""Matching records of two tables by nearest time.

Both tables are cut by (entity, time bucket): a left row lives in the bucket of its time, a
right row in every bucket whose left rows it could serve, that is with a margin of one
tolerance on both sides. Buckets are hashed into groups of a bounded mean size and co-grouped;
within a group one composite sorted array and two binary searches over all left rows at once
give the neighbours before and after. A hot entity is spread by its time buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mean number of rows, of both tables together, that one co-grouped call holds.
ROWS_PER_GROUP = 100_000


def _match_group(left: pd.DataFrame, right: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="int64")})
    # One code per (entity, bucket) of the left side; right rows elsewhere can't match.
    cell_l = left["entity"] + "\x00" + left["bucket"].astype(str)
    cell_r = right["entity"] + "\x00" + right["bucket"].astype(str)
    codes, names = pd.factorize(cell_l)
    code_r = pd.Index(names).get_indexer(cell_r)
    inside = code_r >= 0
    if not inside.any():
        return pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="int64")})
    t_l, t_r = left["t"].to_numpy(np.int64), right["t"].to_numpy(np.int64)[inside]
    c_r, id_r = code_r[inside].astype(np.int64), right["id"].to_numpy(np.int64)[inside]
    # (cell, time) as one number: cells are laid out along one axis, further apart than any reach.
    base = min(t_l.min(), t_r.min())
    span = int(max(t_l.max(), t_r.max()) - base) + 2 * tolerance + 2
    if span * (len(names) + 1) < 2**62:
        key_r, key_l = c_r * span + (t_r - base), codes * span + (t_l - base)
    else:  # ranks of the distinct times stand for the times
        times = np.unique(np.concatenate([t_l, t_r]))
        key_r = c_r * (len(times) + 1) + np.searchsorted(times, t_r)
        key_l = codes * (len(times) + 1) + np.searchsorted(times, t_l)
    order = np.lexsort((id_r, key_r))
    key_r, c_r, t_r, id_r = key_r[order], c_r[order], t_r[order], id_r[order]
    first = np.concatenate([[True], key_r[1:] != key_r[:-1]])  # smallest id of each instant
    key_r, c_r, t_r, id_r = key_r[first], c_r[first], t_r[first], id_r[first]

    after = np.searchsorted(key_r, key_l, side="left")
    none = np.iinfo(np.int64).max
    gaps, ids = [], []
    for at in (after - 1, after):
        ok = (at >= 0) & (at < len(key_r))
        at = np.clip(at, 0, len(key_r) - 1)
        ok &= c_r[at] == codes
        gap = np.where(ok, np.abs(t_r[at] - t_l), none)
        gaps.append(np.where(gap <= tolerance, gap, none))
        ids.append(id_r[at])
    before_wins = (gaps[0] < gaps[1]) | ((gaps[0] == gaps[1]) & (ids[0] < ids[1]))
    gap = np.where(before_wins, gaps[0], gaps[1])
    best = np.where(before_wins, ids[0], ids[1])
    hit = gap < none
    return pd.DataFrame({"left_id": left["id"].to_numpy(np.int64)[hit], "right_id": best[hit]})


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    tolerance_micros: int,
    rows_per_group: int = ROWS_PER_GROUP,
    bucket_micros: int | None = None,
) -> DataFrame:
    """``(left_id long, right_id long)``: for each left row the right row of the same entity
    with the least absolute time difference, at most ``tolerance_micros`` (inclusive).

    Both sides have ``id`` (long), ``entity`` (string) and ``t`` (timestamp); other columns are
    ignored. Ties go to the smaller right id. Rows with a null id, entity or time take no part;
    repeated left rows are answered each, repeated right rows change nothing; a right row may
    serve many left rows. Left rows without a partner give no row; empty tables give none.
    """
    width = bucket_micros or 2 * tolerance_micros + 1
    clean = "id is not null and entity is not null and t is not null"
    cols = (F.col("id").cast("long").alias("id"), F.col("entity"), F.unix_micros(F.col("t").cast("timestamp")).alias("t"))
    lhs = left.filter(clean).select(*cols).withColumn("bucket", F.expr(f"t div {width} - if(t % {width} < 0, 1, 0)"))
    edge = "({0}) div %d - if(({0}) %% %d < 0, 1, 0)" % (width, width)
    low, high = edge.format(f"t - {tolerance_micros}"), edge.format(f"t + {tolerance_micros}")
    # Rows of one instant can't differ but in the id: the smallest stands for them.
    rhs = (
        right.filter(clean)
        .select(*cols)
        .groupBy("entity", "t")
        .agg(F.min("id").alias("id"))
        .select("id", "entity", "t", F.explode(F.expr(f"sequence({low}, {high})")).alias("bucket"))
    )
    total = left.count() + right.count()
    groups = max(1, -(-total // rows_per_group), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = F.pmod(F.xxhash64("entity", "bucket"), F.lit(groups)).alias("cell")
    return (
        lhs.select("id", "entity", "t", "bucket", cell)
        .groupBy("cell")
        .cogroup(rhs.select("id", "entity", "t", "bucket", cell).groupBy("cell"))
        .applyInPandas(lambda a, b: _match_group(a, b, tolerance_micros), "left_id long, right_id long")
    )
