"""Columns over text: ASCII lower case, tokens, part-of-speech suffixes, distance weights."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the C locale. A no-break space is not among it.
SPACE = r"[ \t\n\x0B\f\r]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    """The maximal runs of other than white space, as an array."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalise_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "7")


def strip_pos(word: Column) -> Column:
    """What stands before the first underscore, unless that opens the word."""
    return F.when(F.instr(word, "_") > 1, F.substring_index(word, "_", 1)).otherwise(word)


def integer_prefix(text: Column) -> Column:
    """The integer that text begins with, 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def distance_weight(distance: int, window: int, weight: int) -> float:
    """0: 1; 1: harmonic; 2: linear; other codes: 1."""
    return {1: 1.0 / distance, 2: 1.0 + (1.0 - distance) / window}.get(weight, 1.0)
