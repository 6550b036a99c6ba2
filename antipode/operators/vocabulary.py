"""Word counts and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_counts(tokens: DataFrame) -> DataFrame:
    """word, count double"""
    return tokens.groupBy("word").agg(F.count("*").cast("double").alias("count"))


def ngram_word_counts(records: DataFrame) -> DataFrame:
    """word, count double: a fifth of each record's count for each of its words."""
    return records.groupBy("word").agg((F.sum("match_count") / F.lit(5.0)).alias("count"))


def _most(counts: DataFrame, n: int, ties: str) -> DataFrame:
    if ties == "strict":
        return counts.orderBy(F.desc("count"), "word").limit(n)
    # The (n+1)-th largest count, or none with fewer words: a top-k and an aggregate, no global sort.
    least = counts.select("count").orderBy(F.desc("count")).limit(n + 1)
    least = least.agg(F.when(F.count("*") > n, F.min("count")).otherwise(F.lit(0.0)).alias("least"))
    return counts.crossJoin(F.broadcast(least)).where(F.col("count") >= F.col("least")).drop("least")


def vocabulary(counts: DataFrame, n: int, minimum: float = 0.0, dictionary: DataFrame | None = None, ties: str = "whole") -> DataFrame:
    """id, word, count, is_dict: the most frequent words in order of count, then word. With ties="whole" all
    words of rank up to n + 1 are in, with "strict" n words. Words of the dictionary come after them
    whatever their count, in order of word. Only the vocabulary itself is numbered in one task."""
    rows = counts.where(F.col("count") >= minimum)
    if dictionary is not None:
        rows = rows.join(dictionary, "word", "left_anti")
    kept = _most(rows, n, ties).select("word", "count", F.lit(False).alias("is_dict"))
    if dictionary is not None:
        own = dictionary.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0.0)).alias("count"), F.lit(True).alias("is_dict"))
        kept = kept.unionByName(own)
    order = Window.orderBy("is_dict", F.when(~F.col("is_dict"), F.col("count")).desc(), "word")
    return kept.withColumn("id", (F.row_number().over(order) - 1).cast("bigint")).select("id", "word", "count", "is_dict")


def encode(tokens: DataFrame, vocab: DataFrame, *key: str) -> DataFrame:
    """key, pos, id: null for words out of the vocabulary, which keep their positions. Spark broadcasts the
    vocabulary if it is below the broadcast threshold, and joins by word otherwise."""
    return tokens.join(vocab.select("word", "id"), "word", "left").select(*key, "pos", "id")
