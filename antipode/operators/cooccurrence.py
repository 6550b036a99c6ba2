"""Windowed, weighted word co-occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance_weight, lower_ascii, tokens
from .vocabulary import encode

#: The largest vocabulary that is sent to every task (about 50 MB).
BROADCAST_WORDS = 1_000_000


def _both_ways(pairs: DataFrame, *rest: str) -> DataFrame:
    ways = F.array(F.struct(F.col("w1").alias("a"), F.col("w2").alias("b")), F.struct(F.col("w2").alias("a"), F.col("w1").alias("b")))
    return pairs.select(F.explode(ways).alias("p"), *rest).select(F.col("p.a").alias("w1"), F.col("p.b").alias("w2"), *rest)


def window_pairs(encoded: DataFrame, window: int, *key: str) -> DataFrame:
    """w1, w2, d: pairs of known words at distance d up to window in one sentence; one sort by sentence."""
    line = Window.partitionBy(*key).orderBy("pos")
    ahead = F.array(*(F.struct(F.lead("id", d).over(line).alias("w2"), F.lit(d).alias("d")) for d in range(1, window + 1)))
    rows = encoded.select(F.col("id").alias("w1"), ahead.alias("ahead")).where("w1 IS NOT NULL")
    return rows.select("w1", F.explode("ahead").alias("x")).select("w1", "x.w2", "x.d").where("w2 IS NOT NULL")


def line_pairs(lines: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """w1, w2, d like window_pairs, straight from lines: each word takes the words after it along, and both are looked
    up in the broadcast vocabulary. Nothing is shuffled or sorted before the pairs are counted."""
    words = lines.select(tokens(lower_ascii(F.col("line"))).alias("w"))
    rows = words.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.slice(F.col("w"), i + 2, F.lit(window)).alias("next")))).alias("t"))
    first = F.broadcast(vocab.select("word", F.col("id").alias("w1")))
    other = F.broadcast(vocab.select(F.col("word").alias("word2"), F.col("id").alias("w2")))
    pairs = rows.select("t.word", "t.next").join(first, "word").select("w1", F.posexplode("next").alias("d", "word2"))
    return pairs.join(other, "word2").select("w1", "w2", (F.col("d") + 1).alias("d"))


def _tokenised(lines: DataFrame, *key: str) -> DataFrame:
    words = tokens(lower_ascii(F.col("line")))
    return lines.select(*key, F.posexplode(words).alias("pos", "word"))


def weighted_counts(pairs: DataFrame, window: int, weight: int, symmetric: bool = True) -> DataFrame:
    """w1, w2, count: sums of distance weights. Whole pairs are counted for each distance and weighted once,
    so sums don't depend on the order of addition. Symmetric: each pair counts both ways, and a word next
    to itself twice."""
    pairs = _both_ways(pairs, "d") if symmetric else pairs
    counted = pairs.groupBy("w1", "w2").agg(*(F.sum(F.when(F.col("d") == d, 1).otherwise(0)).alias(f"n_{d}") for d in range(1, window + 1)))
    total = F.lit(0.0)
    for d in range(1, window + 1):
        total = total + F.col(f"n_{d}") * F.lit(distance_weight(d, window, weight))
    return counted.select("w1", "w2", total.alias("count"))


def cooccurrences(encoded: DataFrame, window: int, weight: int, *key: str, symmetric: bool = True) -> DataFrame:
    """w1, w2, count of encoded tokens."""
    return weighted_counts(window_pairs(encoded, window, *key), window, weight, symmetric)


def line_cooccurrences(lines: DataFrame, vocab: DataFrame, window: int, weight: int, *key: str, symmetric: bool = True) -> DataFrame:
    """w1, w2, count of lines (key, line): by line_pairs if the vocabulary is small enough to send to every task, by
    encoded tokens otherwise."""
    if vocab.count() <= BROADCAST_WORDS:
        pairs = line_pairs(lines, vocab, window)
    else:
        pairs = window_pairs(encode(_tokenised(lines, *key), vocab, *key), window, *key)
    return weighted_counts(pairs, window, weight, symmetric)


def sentence_cooccurrences(encoded: DataFrame, *key: str, symmetric: bool = True) -> DataFrame:
    """w1, w2, count: every pair of a sentence, weight 1. Symmetric counts come from the counts of a sentence's words,
    so a long sentence costs the square of its distinct words and not of its length."""
    known = encoded.where("id IS NOT NULL")
    if symmetric:
        counts = known.groupBy(*key, "id").agg(F.count("*").alias("n"))
        left = counts.select(*key, F.col("id").alias("w1"), F.col("n").alias("n1"))
        right = counts.select(*key, F.col("id").alias("w2"), F.col("n").alias("n2"))
        ways = F.col("n1") * (F.col("n2") - F.when(F.col("w1") == F.col("w2"), 1).otherwise(0))
        pairs = left.join(right, list(key)).select("w1", "w2", ways.alias("ways")).where("ways > 0")
        return pairs.groupBy("w1", "w2").agg(F.sum("ways").cast("double").alias("count"))
    left = known.select(*key, F.col("pos").alias("i"), F.col("id").alias("w1"))
    right = known.select(*key, F.col("pos").alias("j"), F.col("id").alias("w2"))
    pairs = left.join(right, list(key)).where("i < j").select("w1", "w2")
    return pairs.groupBy("w1", "w2").agg(F.count("*").cast("double").alias("count"))
