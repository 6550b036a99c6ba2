"""Queries over a model (id, word, bias, grad, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v


def dimension(model: DataFrame) -> int:
    first = model.select(F.size("vec")).first()
    return first[0] if first else 0


def pair_similarity(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """a, b, similarity, cosine of id pairs (a, b) in the model."""
    left = model.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("bias").alias("ba"))
    right = model.select(F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("bias").alias("bb"))
    rows = pairs.join(left, "a").join(right, "b")
    sim = v.similarity(F.col("va"), F.col("ba"), F.col("vb"), F.col("bb"))
    return rows.select("a", "b", sim.alias("similarity"), v.cosine(F.col("va"), F.col("vb")).alias("cosine"))


def similar_words(queries: DataFrame, model: DataFrame, limit: int = 10, reverse: bool = False, batch: int = 1024) -> DataFrame:
    """query, rank, word, similarity: for each query word the limit most similar other words of the model
    (least similar first with reverse), ties by id; a word the model lacks gives limit rows "unknown", 0.

    Queries are a stated set that is met with the whole model in blocks of at most ``batch`` words; each
    task keeps its best rows of a query before anything is shuffled."""
    asked = queries.select("query").distinct()
    known = model.select(F.col("word").alias("query"), F.col("id").alias("qid"), F.col("vec").alias("qv"), F.col("bias").alias("qb"))
    found = asked.join(known, "query")
    n = found.count()
    order = Window.partitionBy("query").orderBy(F.col("sim").asc() if reverse else F.col("sim").desc(), "id")
    blocks = max(1, -(-n // batch))
    out = None
    for block in range(blocks):
        part = found.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        rows = model.select("id", "word", "vec", "bias").crossJoin(F.broadcast(part)).where("id <> qid")
        rows = rows.select("query", "id", "word", v.similarity(F.col("qv"), F.col("qb"), F.col("vec"), F.col("bias")).alias("sim"))
        top = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)
        out = top if out is None else out.unionByName(top)
    hits = out.select("query", "rank", "word", F.col("sim").alias("similarity"))
    lost = asked.join(known.select("query"), "query", "left_anti")
    lost = lost.select("query", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(limit).cast("bigint"))).alias("rank"), F.lit("unknown").alias("word"), F.lit(0.0).alias("similarity"))
    return hits.unionByName(lost)


def sentence_vectors(lines: DataFrame, tokens: DataFrame, model: DataFrame, *key: str) -> DataFrame:
    """key, vec: the sum of the vectors of a sentence's known words, each as often as it stands there; zeros
    without any. Sums are partial before the shuffle, one row a sentence and task."""
    dim = dimension(model)
    known = tokens.join(model.select("word", "vec"), "word").groupBy(*key).agg(v.sum_vectors("vec", dim).alias("vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return lines.select(*key).join(known, list(key), "left").withColumn("vec", F.coalesce("vec", zero))


def mean_word(model: DataFrame) -> DataFrame:
    """bias, vec: the mean of all words."""
    return model.agg(F.avg("bias").alias("bias"), v.mean_vectors("vec", dimension(model)).alias("vec"))
