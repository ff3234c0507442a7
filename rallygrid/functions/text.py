"""Cleaning, name keys and pair keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value (fixed values).
MISSING_TOKENS = ("", "\t", "nan", "None")


def words(text: Column) -> Column:
    """Words between any white space; an empty array for a blank text."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def blanked(text: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def nulled(text: Column) -> Column:
    """Trimmed; tokens that stand for nothing become null."""
    trimmed = F.trim(text)
    return F.when(trimmed.isin(*MISSING_TOKENS), None).otherwise(trimmed)


def canonical_name(name: Column) -> Column:
    """Lower case; hyphens, dots and apostrophes as blanks, single blanks; '' for null."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), "-.'", "   ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def last_initial(name: Column, joint: str = "_") -> Column:
    """``Given Surname`` as ``surname_g``: last word, joint, initial of the first word."""
    w = words(F.lower(name))
    return F.when(F.size(w) > 0, F.concat(F.element_at(w, -1), F.lit(joint), F.substring(F.element_at(w, 1), 1, 1)))


def quoted_last_initial(name: Column, joint: str = "_") -> Column:
    """``Surname G.`` as ``surname_g``; null without a second word."""
    w = words(F.replace(F.lower(name), F.lit("."), F.lit("")))
    return F.when(F.size(w) > 1, F.concat(F.element_at(w, 1), F.lit(joint), F.substring(F.element_at(w, 2), 1, 1)))


def pair_key(a: Column, b: Column, joint: str = "|") -> Column:
    """An order-insensitive key; null when a name is null."""
    return F.concat(F.least(a, b), F.lit(joint), F.greatest(a, b)) if joint else F.concat(F.least(a, b), F.greatest(a, b))


def capitalised(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2_147_483_647)))
