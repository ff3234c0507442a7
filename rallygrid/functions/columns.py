"""Choosing and completing columns by name and type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named columns, whether they exist or not."""
    return df.drop(*names)


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Names of the columns of a numeric type, but for those left out."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def with_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and exactly the features of a model as doubles; those the frame lacks are null."""
    have = set(df.columns)
    full = [(F.col(f"`{c}`").cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in features]
    return df.select(*keys, *full)
