"""From co-occurrences to the training table: sampling statistics, evidence, implicit negatives, thesaurus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sampling as s
from .cooccurrence import BROADCAST_WORDS
from .thesaurus import both_ways

#: Ranks of one array of second words.
RANKS = 1024


def word_stats(vocab: DataFrame, cooc: DataFrame, threshold: float = s.SUBSAMPLING, negatives: int = s.NEGATIVES) -> DataFrame:
    """id, count, keep_p, neg_w, rank (1 for the largest neg_w, ties by id), sub_count, scale: the expected
    negative weight of (w1, w2) is scale(w1) * neg_w(w2). One row a word of the vocabulary."""
    total = vocab.agg(F.sum("count").alias("total"))
    words = vocab.crossJoin(F.broadcast(total)).select(
        "id", "count", s.keep_probability(F.col("count"), F.col("total"), threshold).alias("keep_p"), s.negative_weight(F.col("count")).alias("neg_w")
    )
    other = words.select(F.col("id").alias("w2"), F.col("keep_p").alias("p2"))
    first = words.select(F.col("id").alias("w1"), F.col("keep_p").alias("p1"))
    kept = cooc.join(first, "w1").join(other, "w2").groupBy(F.col("w1").alias("id")).agg(F.sum(F.col("count") * F.col("p1") * F.col("p2")).alias("sub_count"))
    weight = words.agg(F.sum("neg_w").alias("neg_total"))
    words = words.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("neg_w"), "id")).cast("bigint"))
    words = words.join(kept, "id", "left").withColumn("sub_count", F.coalesce("sub_count", F.lit(0.0))).crossJoin(F.broadcast(weight))
    return words.select("id", "count", "keep_p", "neg_w", "rank", "sub_count", F.try_divide(F.col("sub_count") * F.lit(float(negatives)), F.col("neg_total")).alias("scale"))


def observed_expectations(cooc: DataFrame, stats: DataFrame) -> DataFrame:
    """w1, w2, pos_e, neg_e: what each observed pair weighs before rounding."""
    first = stats.select(F.col("id").alias("w1"), F.col("keep_p").alias("p1"), "scale")
    other = stats.select(F.col("id").alias("w2"), F.col("keep_p").alias("p2"), "neg_w")
    rows = cooc.join(first, "w1").join(other, "w2")
    return rows.select("w1", "w2", (F.col("count") * F.col("p1") * F.col("p2")).alias("pos_e"), (F.col("scale") * F.col("neg_w")).alias("neg_e"))


def without_thesaurus(updates: DataFrame, thesaurus: DataFrame) -> DataFrame:
    return updates.join(both_ways(thesaurus).select("w1", "w2").distinct(), ["w1", "w2"], "left_anti")


def observed_updates(cooc: DataFrame, stats: DataFrame, thesaurus: DataFrame, seed: int = 0) -> DataFrame:
    """w1, w2, pos, neg of observed pairs that keep any weight and aren't in the thesaurus."""
    rows = without_thesaurus(observed_expectations(cooc, stats), thesaurus)
    pos = s.rounded(F.col("pos_e"), s.uniform(seed, "pos", F.col("w1"), F.col("w2")))
    neg = s.rounded(F.col("neg_e"), s.uniform(seed, "neg", F.col("w1"), F.col("w2")))
    return rows.select("w1", "w2", pos.alias("pos"), neg.alias("neg")).where("pos > 0 OR neg > 0")


def eligible(stats: DataFrame, least: float = s.MIN_COUNT) -> DataFrame:
    """w1, scale, m: the ranks 1 to m are the second words whose expected weight reaches least. The last
    rank is never in. A sort of the vocabulary finds all m; nothing is compared pair by pair."""
    n = stats.agg(F.count("*").alias("n"))
    bounds = stats.where("scale > 0").select(F.lit(1).alias("kind"), "id", "scale", (F.lit(least) / F.col("scale")).alias("v"))
    weights = stats.select(F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("scale"), F.col("neg_w").alias("v"))
    order = Window.orderBy(F.desc("v"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = bounds.unionByName(weights).withColumn("m", F.sum(1 - F.col("kind")).over(order)).where("kind = 1")
    return counted.crossJoin(F.broadcast(n)).select(F.col("id").alias("w1"), "scale", F.least(F.col("m"), F.col("n") - 1).alias("m")).where("m > 0")


def implicit_negatives(cooc: DataFrame, stats: DataFrame, thesaurus: DataFrame, seed: int = 0) -> DataFrame:
    """w1, w2, pos (0), neg of pairs that were never observed. The draw is of a pair, so each eligible pair is drawn, but
    none is joined or moved for it: second words come as arrays of ``RANKS`` consecutive ranks, one row of the join
    with a first word brings a whole array, and pairs are made, drawn and left out in the same task."""
    ranked = stats.select("rank", F.struct(F.col("id").alias("w2"), "neg_w").alias("x"), F.floor((F.col("rank") - 1) / RANKS).alias("block"))
    blocks = ranked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rank", "x"))).alias("words"))
    last = F.floor((F.col("m") - 1) / RANKS)
    asked = eligible(stats).select("w1", "scale", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    small = stats.count() <= BROADCAST_WORDS
    pairs = asked.join(F.broadcast(blocks) if small else blocks, "block")
    pairs = pairs.select("w1", "scale", "m", F.explode("words").alias("y")).where("y.rank <= m").select("w1", F.col("y.x.w2").alias("w2"), (F.col("scale") * F.col("y.x.neg_w")).alias("e"))
    draw = s.uniform(seed, "implicit", F.col("w1"), F.col("w2"))
    pairs = pairs.where((F.col("e") >= 1) | (draw < F.col("e"))).select("w1", "w2", F.greatest(F.lit(1.0), "e").alias("neg"))
    pairs = pairs.join(cooc.select("w1", "w2"), ["w1", "w2"], "left_anti")
    return without_thesaurus(pairs, thesaurus).select("w1", "w2", F.lit(0.0).alias("pos"), "neg")


def thesaurus_updates(thesaurus: DataFrame) -> DataFrame:
    """w1, w2, pos, neg, origin: both orders of synonyms that aren't antonyms too, and of antonyms."""
    syn = both_ways(thesaurus.where("kind = 'syn'")).select("w1", "w2").distinct()
    ant = both_ways(thesaurus.where("kind = 'ant'")).select("w1", "w2").distinct()
    kept = syn.join(ant, ["w1", "w2"], "left_anti")
    return kept.select("w1", "w2", F.lit(s.SYNONYM_WEIGHT).alias("pos"), F.lit(0.0).alias("neg"), F.lit("syn").alias("origin")).unionByName(
        ant.select("w1", "w2", F.lit(0.0).alias("pos"), F.lit(s.ANTONYM_WEIGHT).alias("neg"), F.lit("ant").alias("origin"))
    )


def update_table(cooc: DataFrame, stats: DataFrame, thesaurus: DataFrame, seed: int = 0) -> DataFrame:
    """w1, w2, pos, neg, origin: all that one epoch learns from."""
    seen = observed_updates(cooc, stats, thesaurus, seed).withColumn("origin", F.lit("observed"))
    unseen = implicit_negatives(cooc, stats, thesaurus, seed).withColumn("origin", F.lit("implicit"))
    return seen.unionByName(unseen).unionByName(thesaurus_updates(thesaurus))


def setup_statistics(cooc: DataFrame, stats: DataFrame, thesaurus: DataFrame, updates: DataFrame) -> DataFrame:
    """One row: what the set-up reports. Synonym matches count those that are antonyms too."""
    pairs = cooc.agg(F.sum("count").alias("count_total"), F.count("*").alias("unique_pairs"))
    sampled = stats.agg(F.sum("sub_count").alias("sampled_total"))
    drawn = updates.where("origin IN ('observed', 'implicit')").agg(F.count("*").alias("updates"), F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total"))
    said = both_ways(thesaurus).distinct().agg(
        F.count(F.when(F.col("kind") == "syn", 1)).alias("synonym_matches"), F.count(F.when(F.col("kind") == "ant", 1)).alias("antonym_matches")
    )
    return pairs.crossJoin(sampled).crossJoin(drawn).crossJoin(said)
