"""Words of texts as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staffline.llm.common import ascii_lower

#: ASCII white space, as characters and as a class.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"
#: What separates words once A-Z are small: ASCII other than digits and letters.
BREAK_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def blank_words(text: Column) -> Column:
    """Runs without ASCII white space; an empty array for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_CLASS)).otherwise(F.array().cast("array<string>"))


def plain_words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z made small; an empty array for null."""
    parts = F.array_remove(F.split(ascii_lower(text), BREAK_CLASS), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")
