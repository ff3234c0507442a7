"""Rolling totals over trailing periods, idle days included.

Deliveries are reduced to one row per real match, matches to one row per entity and day (both
with map-side partial aggregation, so a hot entity never meets as raw rows). The totals of a period
change on active days and as many days later as the period has; running sums of what enters and
leaves give them there, and each holds until the next change. The calendar of an entity is
unfolded between its changes, which yields the entity-calendar product without a join or a
window over it; an entity's partition is bounded by the length of the calendar. Sums are exact for
the whole numbers taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallygrid.functions.dates import readable_date


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: Column,
    measures: Sequence[str],
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """Per entity and calendar day between its first and last active day.

    Columns: ``entity``, ``day date``, ``events_{p}`` (events in the trailing p days, that day
    included) and for every measure and period ``{m}_sum_{p}`` (unknown values count nothing;
    0 where nothing is known), ``{m}_avg_{p}`` (sum over the events with a known value; null
    without any) and ``{m}_daily_{p}`` (sum over p calendar days).

    Rows with a null entity or an unreadable day take no part; an empty table gives no rows.
    Extra columns are ignored, and may be named like the helper columns.
    """
    rows = df.select(
        F.col(f"`{entity}`").alias("e"),
        day.alias("d"),
        *[F.col(f"`{m}`").cast("long").alias(f"m{i}") for i, m in enumerate(measures)],
    ).filter("e is not null and d is not null")
    span = range(len(measures))
    columns = ("n", *[f"s{i}" for i in span], *[f"c{i}" for i in span])
    # The calendar multiplies rows, so the few rows before it are spread by a set number of
    # partitions, which adaptive coalescing leaves alone.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    daily = rows.groupBy("e", "d").agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"s{i}") for i in span],
        *[F.count(f"m{i}").alias(f"c{i}") for i in span],
    ).repartition(parts, "e")
    # What a day adds enters the total of period p on that day and leaves it p days on. The totals
    # only change on such days: they run over these, and the calendar is unfolded between them.
    no = F.lit(0).cast("long")
    enter = F.struct(F.col("d").alias("day"), F.col("d").alias("active"), *[F.col(c).alias(f"{c}_{p}") for p in periods for c in columns])
    leave = [
        F.struct(F.date_add("d", p).alias("day"), F.lit(None).cast("date").alias("active"), *[(-F.col(c) if q == p else no).alias(f"{c}_{q}") for q in periods for c in columns])
        for p in periods
    ]
    changes = daily.select("e", F.explode(F.array(enter, *leave)).alias("x")).select("e", "x.*")
    changes = changes.groupBy("e", "day").agg(F.max("active").alias("active"), *[F.sum(f"{c}_{p}").alias(f"{c}_{p}") for p in periods for c in columns])
    ordered = Window.partitionBy("e").orderBy("day")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = changes.select(
        "e", "day", F.date_sub(F.lead("day").over(ordered), 1).alias("until"), F.max("active").over(whole).alias("last"),
        *[F.sum(f"{c}_{p}").over(running).alias(f"{c}_{p}") for p in periods for c in columns],
    ).filter("day <= last")
    out = []
    for p in periods:
        out.append(F.col(f"n_{p}").alias(f"events_{p}"))
        for i, m in enumerate(measures):
            total, known = F.col(f"s{i}_{p}"), F.col(f"c{i}_{p}")
            out += [
                total.alias(f"{m}_sum_{p}"),
                F.when(known > 0, total / known).alias(f"{m}_avg_{p}"),
                (total / F.lit(float(p))).alias(f"{m}_daily_{p}"),
            ]
    days = F.sequence("day", F.least(F.coalesce("until", "last"), F.col("last")))
    ready = totals.select(F.col("e").alias("_e"), days.alias("_days"), *out)
    named = [F.col(f"`{c}`") for c in ready.columns if c not in ("_e", "_days")]
    return ready.select(F.col("_e").alias(entity), F.explode("_days").alias("day"), *named)


def once_per_match(df: DataFrame, varying: Sequence[str] = ("row_id", "loaded_at", "tourney_date")) -> DataFrame:
    """One row per match and player where deliveries repeat it under a new row id.

    Deliveries of one match agree in all but ``varying`` columns. They are grouped by player,
    opponent, tournament and round plus a 64-bit digest of the rest; the result has all columns but
    ``tourney_date``, ``match_day`` (the largest readable date of the deliveries), and ``row_id`` and
    ``loaded_at`` of the latest delivery. What a query doesn't use is pruned before the shuffle.
    """
    same = ["player_id", "opponent_id", "tourney_id", "round"]
    rest = [c for c in df.columns if c not in (*varying, *same)]
    digest = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in rest])
    latest = F.struct("loaded_at", "row_id")
    return (
        df.withColumn("content_digest", digest)
        .groupBy(*same, "content_digest")
        .agg(
            F.max(readable_date(F.col("tourney_date"))).alias("match_day"),
            F.max(latest).getField("row_id").alias("row_id"),
            F.max("loaded_at").alias("loaded_at"),
            *[F.first(f"`{c}`").alias(c) for c in rest],
        )
    )
