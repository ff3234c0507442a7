"""Right-closed buckets and bucket dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Ordinal (from 0) of the interval ``(lo, hi]`` that holds the value; null outside."""
    out = F.lit(None).cast("int")
    pairs = list(zip(edges[:-1], edges[1:]))
    for i, (lo, hi) in reversed(list(enumerate(pairs))):
        above = value >= lo if include_lowest and i == 0 else value > lo
        out = F.when(above & (value <= hi), i).otherwise(out)
    return out


def label(ordinal: Column, edges: Sequence[float]) -> Column:
    """``lo:hi`` of a bucket ordinal; null for null."""
    out = F.lit(None).cast("string")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        out = F.when(ordinal == i, f"{lo:g}:{hi:g}").otherwise(out)
    return out


def cut_sql(value: str, edges: Sequence[float], include_lowest: bool = False) -> str:
    """The same ordinal as SQL text."""
    arms = []
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        sign = ">=" if include_lowest and i == 0 else ">"
        arms.append(f"WHEN {value} {sign} {lo} AND {value} <= {hi} THEN {i}")
    return "CASE " + " ".join(arms) + " END"


def dimension(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    """All buckets, for summaries that keep the empty ones."""
    rows = [(i, f"{lo:g}:{hi:g}") for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
    return spark.createDataFrame(rows, "bucket int, label string")
