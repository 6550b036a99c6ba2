"""Columns of the sampling statistics. Draws are hashes of (seed, tag, key), so they need no state and
are the same in any order and on any retry; they have 16 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the training set-up.
NEGATIVES = 5
MIN_COUNT = 1e-5
SUBSAMPLING = 1e-8
SYNONYM_WEIGHT = 100.0
ANTONYM_WEIGHT = 1305702 / 408302 * 100


def keep_probability(count: Column, total: Column, threshold: float = SUBSAMPLING) -> Column:
    s = count / (F.lit(threshold) * total)
    return F.least(F.coalesce(F.try_divide(F.sqrt(s) + 1, s), F.lit(1.0)), F.lit(1.0))


def negative_weight(count: Column) -> Column:
    return F.pow(count, F.lit(0.75))


def uniform(seed: int, tag: str, *key: Column) -> Column:
    said = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def rounded(x: Column, draw: Column, least: float = MIN_COUNT) -> Column:
    """Below least 0; below 1 a draw of 0 or 1; else x."""
    return F.when(x < least, F.lit(0.0)).when(x < 1, F.when(draw < x, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(x)
