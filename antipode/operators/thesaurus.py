"""Synonym and antonym pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def thesaurus(lines: DataFrame, vocab: DataFrame, kind: str) -> DataFrame:
    """a, b, kind with a < b: the first word of a line with each other word of it, both in the vocabulary."""
    words = t.tokens(t.lower_ascii(F.col("line")))
    pairs = lines.select(F.get(words, F.lit(0)).alias("head"), F.explode(F.slice(words, 2, F.size(words))).alias("related"))
    ids = vocab.select("word", "id")
    pairs = pairs.join(ids.withColumnsRenamed({"word": "head", "id": "x"}), "head").join(ids.withColumnsRenamed({"word": "related", "id": "y"}), "related")
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.distinct().withColumn("kind", F.lit(kind))


def both_ways(pairs: DataFrame) -> DataFrame:
    """w1, w2, kind: each pair in both orders."""
    ways = F.array(F.struct(F.col("a").alias("w1"), F.col("b").alias("w2")), F.struct(F.col("b").alias("w1"), F.col("a").alias("w2")))
    return pairs.select(F.explode(ways).alias("p"), "kind").select("p.w1", "p.w2", "kind")


def in_thesaurus(pairs: DataFrame, thesaurus: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Adds a boolean: are the two ids a pair of the thesaurus, in either order? A null id never is."""
    known = thesaurus.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_in")).distinct()
    match = (F.least(left, right) == F.col("_a")) & (F.greatest(left, right) == F.col("_b")) & F.col(left).isNotNull() & F.col(right).isNotNull()
    return pairs.join(known, match, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_a", "_b", "_in")
