"""Last-N and point-in-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], n: int) -> DataFrame:
    """The newest n rows per key. The rank filter lets Spark keep n rows per key and task before
    the shuffle (group limit), so a hot key never moves whole."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def before_date_last_n(
    df: DataFrame, keys: Sequence[str], date: str, tie: str, measures: Sequence[str], sizes: Sequence[int]
) -> DataFrame:
    """Per row: sums over the most recent N rows of its keys with a strictly earlier date.

    Adds ``history`` (number of earlier-dated rows), and ``{m}_last{N}`` per measure and size
    (null values count 0; null without history). Rows of one date share their history.

    Rows are first put into order arrays per (key, date): prefix sums run over the rows, and a
    row at date d reads the prefix at the last row before d and the one N rows earlier. Both are
    window expressions over the same partitioning and order: one shuffle, no self join.
    """
    part = Window.partitionBy(*keys)
    rows = part.orderBy(date, tie)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_k", F.row_number().over(rows))
    for m in measures:
        out = out.withColumn(f"_c_{m}", F.sum(F.coalesce(F.col(m), F.lit(0))).over(upto))
    # Number of rows before the date: the rank among dates less one.
    out = out.withColumn("history", (F.rank().over(part.orderBy(date)) - 1).cast("long"))
    # Rows of one date differ in k - history, so a frame by distance needs that offset; the
    # prefix at rank h of the same key is the value lagged by (k - h) rows.
    first_of_day = Window.partitionBy(*keys, date).orderBy(tie)
    for m in measures:
        own = F.coalesce(F.col(m), F.lit(0))
        day_before = F.first(F.col(f"_c_{m}") - own).over(
            first_of_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
        out = out.withColumn(f"_p_{m}", day_before)
    for n in sizes:
        lagged = part.orderBy("_k").rowsBetween(-n, -n)
        for m in measures:
            # Prefix sum n rows before the first row of the date, taken at that row, shared by the date.
            at_first = F.coalesce(F.first(F.col(f"_c_{m}") - F.coalesce(F.col(m), F.lit(0))).over(lagged), F.lit(0))
            out = out.withColumn(f"_q_{m}_{n}", at_first)
            shared = F.first(f"_q_{m}_{n}").over(
                first_of_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            )
            out = out.withColumn(
                f"{m}_last{n}", F.when(F.col("history") > 0, F.col(f"_p_{m}") - shared)
            )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def days_since_last(df: DataFrame, keys: Sequence[str], date: str, order: Sequence[str]) -> Column:
    """Days since the key's previous row, -1 for its first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.date_diff(F.col(date), F.lag(date).over(w)), F.lit(-1))


def rows_before(keys: Sequence[str], order: Sequence[str]) -> Column:
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
