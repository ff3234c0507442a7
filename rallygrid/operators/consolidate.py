"""Consolidation of history and new rows, keep-first and best-row reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(history: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History plus the fresh rows whose key isn't in it; columns are united by name, absent ones
    null. Null keys never equal anything, so such fresh rows are appended."""
    new = fresh.join(history.select(*keys).distinct(), list(keys), "left_anti")
    return history.unionByName(new, allowMissingColumns=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key: the first in a total order. A pre-aggregated minimum, so copies of a hot
    key are reduced before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
