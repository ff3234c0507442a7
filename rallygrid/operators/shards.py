"""Merges along time that stay bounded for entities of any size.

Entities with more rows than ``shard_rows`` are cut along time: rows are counted per entity and
hour, and a shard begins wherever another ``shard_rows`` rows have passed, so every entity has
cuts of its own. Each shard gets the best version of all its entity's earlier shards as a
carried-in row; the shards' merges are then independent and yet exact. All inputs take this one
path; without such entities the table of cuts is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallygrid.session import broadcast_if_small, cut_lineage

SHARD_ROWS = 50_000
_HOUR = 3_600


def latest_versions(rows: DataFrame, rank: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For every event the highest ranking version in effect at its time, in ``known``.

    ``rows``: ``entity`` (not null), ``t`` (timestamp), ``kind`` (0 version, 1 event), ``event``,
    ``version`` (null where of the other kind). ``rank`` is an SQL expression over ``version`` by which
    versions are compared. At one instant versions stand before events."""
    heavy = rows.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).select("entity")
    marks, _ = broadcast_if_small(cut_lineage(heavy))
    hour = F.floor(F.unix_seconds("t") / _HOUR).alias("hour")
    hours = rows.join(marks, "entity", "left_semi").groupBy("entity", hour).agg(F.count("*").alias("n"))
    # Hours of one entity, not rows: bounded by the calendar.
    upto = Window.partitionBy("entity").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = hours.withColumn("shard", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / shard_rows))
    starts = starts.groupBy("entity", "shard").agg(F.min("hour").alias("start")).filter("shard > 0")
    borders = cut_lineage(starts.groupBy("entity").agg(F.array_sort(F.collect_list("start")).alias("borders")))
    cuts, _ = broadcast_if_small(borders)
    shard = F.coalesce(F.expr("size(filter(borders, b -> b <= floor(unix_seconds(t) / 3600)))"), F.lit(0))
    rows = rows.join(cuts, "entity", "left").withColumn("shard", shard).drop("borders")
    # One best version per shard of a cut entity, pre-aggregated.
    best = rows.filter("kind = 0").join(cuts, "entity", "left_semi").groupBy("entity", "shard").agg(F.expr(f"max_by(version, {rank})").alias("version"))
    spans = borders.select("entity", F.explode(F.sequence(F.lit(0), F.size("borders"))).alias("shard"))
    order = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spans.join(best, ["entity", "shard"], "left")
        .withColumn("version", F.expr(f"max_by(version, {rank})").over(order))
        .filter("version is not null")
        .select("entity", "shard", F.lit(None).cast("timestamp").alias("t"), F.lit(-1).alias("kind"), "version")
    )
    rows = rows.unionByName(carried, allowMissingColumns=True)
    # Nulls (the carried-in version) sort first.
    merge = Window.partitionBy("entity", "shard").orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("known", F.expr(f"max_by(version, {rank})").over(merge)).filter("kind = 1").drop("kind", "version", "shard")
