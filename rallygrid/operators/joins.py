"""As-of joins and shift sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallygrid.operators.shards import SHARD_ROWS, latest_versions


def backward_asof(
    events: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    event_time: str,
    state_time: str,
    tie: str,
    payload: Sequence[str],
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Each event with the last state of its key at or before its time: one sorted merge of both
    tables, sharded along time for keys of many rows, instead of a range join; states of one time
    are ordered by ``tie``. Events without such a state, or with a null key or time, get nulls; states
    with a null key or time take no part. Repeated events are answered each."""
    key = F.struct(*[F.col(k) for k in keys]).alias("entity")
    whole = lambda t: " and ".join(f"`{c}` is not null" for c in (*keys, t))
    event = F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("event")
    ev = events.filter(whole(event_time)).select(key, F.col(event_time).cast("timestamp").alias("t"), F.lit(1).alias("kind"), event)
    version = F.struct(*[F.col(f"`{c}`") for c in (state_time, tie, *payload)]).alias("version")
    st = states.filter(whole(state_time)).select(key, F.col(state_time).cast("timestamp").alias("t"), F.lit(0).alias("kind"), version)
    found = latest_versions(ev.unionByName(st, allowMissingColumns=True), f"struct(version.`{state_time}`, version.`{tie}`)", shard_rows)
    found = found.unionByName(events.filter(f"not ({whole(event_time)})").select(event), allowMissingColumns=True)
    return found.select("event.*", *[F.col(f"known.`{c}`").alias(c) for c in (state_time, tie, *payload) if c not in events.columns])


def shift_sweep(left: DataFrame, right: DataFrame, date: str, keys: Sequence[str], shifts: Sequence[int]) -> DataFrame:
    """For each shift of the left dates: how many distinct left rows meet a right row."""
    shifted = left.select(*keys, date).distinct().withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn(date, F.date_add(date, F.col("shift")))
    hits = shifted.join(right.select(*keys, date).distinct(), [*keys, date], "left_semi")
    return hits.groupBy("shift").agg(F.count("*").alias("overlap"))
