"""Choose-the-opposite questions: scores, answers and precision, recall, F."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from .thesaurus import in_thesaurus


def question_scores(questions: DataFrame, model: DataFrame, antonyms: DataFrame | None = None) -> DataFrame:
    """qid, pos, target, candidate, sim, in_dict: one row per candidate of a question whose target the model knows. sim
    is null for a candidate that it doesn't know."""
    left = model.select(F.col("word").alias("target"), F.col("id").alias("tid"), F.col("vec").alias("tv"), F.col("bias").alias("tb"))
    right = model.select(F.col("word").alias("candidate"), F.col("id").alias("cid"), F.col("vec").alias("cv"), F.col("bias").alias("cb"))
    rows = questions.select("qid", "target", F.posexplode("candidates").alias("pos", "candidate"))
    rows = rows.join(left, "target").join(right, "candidate", "left")
    rows = rows.withColumn("sim", v.similarity(F.col("tv"), F.col("tb"), F.col("cv"), F.col("cb"))).select("qid", F.col("pos").cast("bigint").alias("pos"), "target", "tid", "candidate", "cid", "sim")
    if antonyms is None:
        rows = rows.withColumn("in_dict", F.lit(False))
    else:
        rows = in_thesaurus(rows, antonyms, "tid", "cid", "in_dict")
    return rows.select("qid", "pos", "target", "candidate", "sim", "in_dict")


def question_answers(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """qid, chosen, answer, correct: of answered questions, those with no unknown word. The first of equal least
    scores is chosen."""
    chosen = scores.groupBy("qid").agg(F.min_by("candidate", F.struct("sim", "pos")).alias("chosen"), F.bool_or(F.col("sim").isNull()).alias("lost"))
    rows = questions.select("qid", "answer").join(chosen.where(~F.col("lost")), "qid")
    return rows.select("qid", "chosen", "answer", (F.col("chosen") == F.col("answer")).alias("correct"))


def metrics(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """total, answered, correct, precision, recall, f: null where the quotient is 0/0."""
    total = questions.agg(F.count("*").alias("total"))
    right = answers.agg(F.count("*").alias("answered"), F.count(F.when(F.col("correct"), 1)).alias("correct"))
    p = F.try_divide(F.col("correct").cast("double"), F.col("answered").cast("double"))
    r = F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double"))
    rows = total.crossJoin(right).withColumn("precision", p).withColumn("recall", r)
    return rows.withColumn("f", F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
