"""Two-sided rows as per-entity rows, and mirrored rows - one scan, no union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_sides(df: DataFrame, shared: Sequence[str], sides: Sequence[Mapping[str, object]]) -> DataFrame:
    """One row per side: the shared columns and the side's (output name -> column)."""
    structs = [F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in s.items()]) for s in sides]
    return df.select(*shared, F.explode(F.array(*structs)).alias("side")).select(*shared, "side.*")


def winner_loser_rows(df: DataFrame, shared: Sequence[str]) -> DataFrame:
    """``player_id, opponent_id, won int`` per match and player."""
    return unpivot_sides(
        df,
        shared,
        [
            {"player_id": "winner_id", "opponent_id": "loser_id", "won": F.lit(1)},
            {"player_id": "loser_id", "opponent_id": "winner_id", "won": F.lit(0)},
        ],
    )
