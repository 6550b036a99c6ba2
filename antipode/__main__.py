"""The engine's four programs: ``python -m antipode vocabulary | cooccurrence | train | score``."""

from __future__ import annotations

import argparse
import contextlib
import resource
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antipode.operators import cooccurrence, evaluation, similarity, thesaurus, training, updates, vocabulary
from antipode.sources import corpus, storage


@contextlib.contextmanager
def timed(phase: str):
    """Says how long a phase took, and the most memory that the driver's Python had by then."""
    began = time.perf_counter()
    yield
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
    print(f"{time.strftime('%Y-%m-%d %H:%M:%S')} {phase}: {time.perf_counter() - began:.1f} s, driver {peak} MB", file=sys.stderr)


def count_words(spark: SparkSession, folder: str, n: int, out: str, minimum: float = 0, dictionary: str | None = None, ngrams: bool = False, native: str | None = None) -> DataFrame:
    """Writes the vocabulary of a folder of gzip files: lines of text, or n-gram records; and as a native file too."""
    lines = corpus.read_corpus(spark, folder)
    if ngrams:
        counts = vocabulary.ngram_word_counts(corpus.ngram_records(lines))
    else:
        counts = vocabulary.word_counts(corpus.tokenise(lines))
    words = None if dictionary is None else corpus.dictionary_words(corpus.read_lines(spark, dictionary))
    with timed("vocabulary"):
        vocabulary.vocabulary(counts, n, minimum, words).write.mode("overwrite").parquet(out)
    if native:
        storage.write_vocabulary_file(spark.read.parquet(out), native)
    return spark.read.parquet(out)


def count_pairs(spark: SparkSession, folder: str, vocab: str, out: str, window: int, weight: int, native: str | None = None) -> DataFrame:
    """Writes the co-occurrences of a folder of gzip files; and as a native file too."""
    lines = storage.written(corpus.read_corpus(spark, folder).select("line", F.monotonically_increasing_id().alias("sentence")), "sentences")
    with timed("co-occurrences"):
        cooccurrence.line_cooccurrences(lines, spark.read.parquet(vocab), window, weight, "sentence").write.mode("overwrite").parquet(out)
    if native:
        storage.write_cooccurrence_file(spark.read.parquet(out), native)
    return spark.read.parquet(out)


def _relations(spark: SparkSession, vocab: DataFrame, synonyms: str | None, antonyms: str | None) -> DataFrame:
    pairs = spark.createDataFrame([], "a bigint, b bigint, kind string")
    for path, kind in ((synonyms, "syn"), (antonyms, "ant")):
        if path:
            pairs = pairs.unionByName(thesaurus.thesaurus(corpus.read_lines(spark, path), vocab, kind))
    return pairs


def train_model(
    spark: SparkSession, vocab: str, cooc: str, model: str, epochs: int, dim: int | None = None, synonyms: str | None = None, antonyms: str | None = None, tasks: int | None = None, seed: int = 0, native: str | None = None
) -> list[float]:
    """Trains a model of dim dimensions, or goes on with the saved one without dim; the cost of each epoch. Each epoch is
    saved under ``model`` before the next begins."""
    words, pairs = spark.read.parquet(vocab), spark.read.parquet(cooc)
    with timed("set-up"):
        stats = storage.written(updates.word_stats(words, pairs), "stats")
        table = storage.written(updates.update_table(pairs, stats, _relations(spark, words, synonyms, antonyms), seed), "updates")
    rows, done = (training.initial_model(words, dim, seed), 0) if dim else storage.load_model(spark, model)
    rows = storage.written(rows, "model")  # the saved one is replaced below
    costs = []
    for epoch in range(done, done + epochs):
        with timed(f"epoch {epoch}"):
            rows, cost, changes = training.train_epoch(rows, table, tasks or spark.sparkContext.defaultParallelism, seed, epoch)
        print(f"epoch {epoch}: cost {cost}, updates {changes}", file=sys.stderr)
        with timed("saved"):
            storage.save_model(rows, model, epoch + 1)
        costs.append(cost)
    if native:
        storage.write_model_file(rows, native, done + epochs)
    return costs


def score(spark: SparkSession, model: str, questions: str, vectors: str | None = None, antonyms: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores of all candidates, one row of metrics). vectors: "plain" or "with-id" if model is a text file of vectors."""
    if vectors:
        lines = spark.read.text(model, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
        words = corpus.vector_lines(lines.withColumn("line_no", F.col("line_no").cast("bigint")), with_id=vectors == "with-id")
    else:
        words = storage.load_model(spark, model)[0]
    asked = storage.written(corpus.questions(corpus.read_lines(spark, questions).withColumn("qid", F.monotonically_increasing_id()), "qid"), "questions")
    pairs = thesaurus.thesaurus(corpus.read_lines(spark, antonyms), words, "ant") if antonyms else None
    scores = evaluation.question_scores(asked, words, pairs)
    return scores, evaluation.metrics(asked, evaluation.question_answers(asked, scores))


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="antipode", description=__doc__)
    sub = parser.add_subparsers(dest="program", required=True)
    p = sub.add_parser("vocabulary")
    p.add_argument("folder"), p.add_argument("n", type=int), p.add_argument("out")
    p.add_argument("--minimum", type=float, default=0), p.add_argument("--dictionary"), p.add_argument("--ngrams", action="store_true"), p.add_argument("--native")
    p = sub.add_parser("cooccurrence")
    p.add_argument("folder"), p.add_argument("vocab"), p.add_argument("out"), p.add_argument("window", type=int)
    p.add_argument("--weight", type=int, default=1, choices=(0, 1, 2), help="0 none, 1 harmonic, 2 linear")
    p.add_argument("--native", help="the native file to write too")
    p = sub.add_parser("train")
    p.add_argument("vocab"), p.add_argument("cooc"), p.add_argument("model"), p.add_argument("epochs", type=int)
    p.add_argument("--dim", type=int, help="without it the saved model is trained on")
    p.add_argument("--synonyms"), p.add_argument("--antonyms"), p.add_argument("--tasks", type=int), p.add_argument("--seed", type=int, default=0), p.add_argument("--native")
    p = sub.add_parser("score")
    p.add_argument("model"), p.add_argument("questions"), p.add_argument("--vectors", choices=("plain", "with-id")), p.add_argument("--antonyms")
    p = sub.add_parser("similar")
    p.add_argument("model"), p.add_argument("word"), p.add_argument("--limit", type=int, default=10), p.add_argument("--reverse", action="store_true")
    o = vars(parser.parse_args(args))
    program = o.pop("program")
    spark = SparkSession.builder.appName(f"antipode {program}").getOrCreate()
    if program == "vocabulary":
        count_words(spark, **o)
    elif program == "cooccurrence":
        count_pairs(spark, **o)
    elif program == "train":
        train_model(spark, **o)
    elif program == "score":
        scores, metrics = score(spark, **o)
        scores.orderBy("qid", "pos").show(50, truncate=False)
        metrics.show()
    else:
        words = spark.createDataFrame([(o["word"],)], "query string")
        similarity.similar_words(words, storage.load_model(spark, o["model"])[0], o["limit"], o["reverse"]).orderBy("rank").show(o["limit"], truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
