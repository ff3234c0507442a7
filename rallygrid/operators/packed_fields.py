"""Several values packed in one field: one row per value, with its position.

A *delimiter skeleton* is the text with every ordinary character masked one to one (digits
become ``9``, letters ``a``; the letters of a walkover mark stay). Texts of one skeleton split
alike, so the splitting rule - the start and length of every piece - is resolved once per
distinct skeleton, joined back (broadcast when its measured size allows) and applied by
position inside the JVM. Long texts whose skeletons are all different make the rule table as
large as the input; it is then joined by a salted shuffle, so a skeleton that a third of the
rows share is spread as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallygrid.session import broadcast_if_small, cut_lineage, own_columns

#: Characters that separate pieces outside quotes, beside any white space.
SEPARATORS = ";,|/"
_SALTS = 16

_PIECE = re.compile(
    r'"(?:[^"]|"")*"(?=$|[\s;,|/])'  # quoted text, doubled quotes inside
    r"|'(?:[^']|'')*'(?=$|[\s;,|/])"
    r"|\[[^\[\]]*\]"  # a match tie-break
    r"|w/o(?![9a-z])"  # a walkover mark
    r"|(?:(?!w/o(?![9a-z]))[^\s;,|/(])+(?:\s*\([^()]*\))*"  # a set with its tie-break
    r"|\([^()]*\)|\(",
)


def skeleton(text: Column) -> Column:
    """Mask ordinary characters, one for one; ``w`` and ``o`` stay for walkover marks."""
    masked = F.regexp_replace(text, r"[wW]", "w")
    masked = F.regexp_replace(masked, r"[oO]", "o")
    masked = F.regexp_replace(masked, r"[\p{L}\p{M}&&[^wo]]", "a")
    return F.regexp_replace(masked, r"\p{N}", "9")


def split_rule(shape: str) -> list[tuple[int, int, str]]:
    """Pieces of a skeleton: start (from 1), length and enclosing quote (or ``''``)."""
    pieces = []
    for found in _PIECE.finditer(shape):
        start, end, quote = found.start(), found.end(), ""
        if end - start >= 2 and shape[start] in "\"'" and shape[end - 1] == shape[start]:
            quote, start, end = shape[start], start + 1, end - 1
        inner = shape[start:end]
        start += len(inner) - len(inner.lstrip())
        end = start + len(inner.strip())
        if end > start:
            pieces.append((start + 1, end - start, quote))
    return pieces


def _resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rules = [split_rule(s) for s in frame["shape"]]
        frame["starts"] = [[p[0] for p in r] for r in rules]
        frame["lengths"] = [[p[1] for p in r] for r in rules]
        frame["quotes"] = [[p[2] for p in r] for r in rules]
        yield frame


def split_packed(df: DataFrame, id_col: str, text_col: str, broadcast_bytes: int | None = None) -> DataFrame:
    """``(id_col, pos int, piece string)``: one row per piece, ``pos`` from 1 in text order.

    Null, empty and blank texts give no rows; empty pieces don't count. Enclosing quotes and
    surrounding blanks are removed, doubled quotes inside made single, all else is unchanged.
    Repeated input rows give repeated output rows; other columns, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    rows = own_columns(df, id_col, text_col).toDF("id", "text").filter("text is not null and text <> ''")
    rows = rows.withColumn("shape", skeleton(F.col("text")))
    rules = cut_lineage(
        rows.select("shape").distinct().mapInPandas(
            _resolve, "shape string, starts array<int>, lengths array<int>, quotes array<string>"
        )
    )
    small, fits = broadcast_if_small(rules) if broadcast_bytes is None else broadcast_if_small(rules, broadcast_bytes)
    if fits:
        joined = rows.join(small, "shape")
    else:
        salted = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(_SALTS)).cast("int")).join(
            salted, ["shape", "salt"]
        )
    at = joined.select(
        "id", "text", F.posexplode(F.arrays_zip("starts", "lengths", "quotes")).alias("at", "rule")
    )
    cut = F.expr("substring(text, rule.starts, rule.lengths)")
    quote = F.col("rule.quotes")
    piece = F.when(quote == "", cut).otherwise(F.expr("replace(substring(text, rule.starts, rule.lengths), repeat(rule.quotes, 2), rule.quotes)"))
    return at.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("pos"), piece.alias("piece"))
