"""Text sources: corpora, n-gram records, dictionaries, questions and vector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.order import number_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file: of text files (gzip too). Only a line feed ends a line; a carriage return is white space."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """line, file: the lines of all ``*.gz`` files right in the folder, one sentence a line. A gzip file is one
    task, so the lines are dealt anew over the cluster."""
    lines = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", "\n").text(folder)
    return lines.select(F.col("value").alias("line"), F.input_file_name().alias("file")).repartition(spark.sparkContext.defaultParallelism)


def sentences(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line: a text column cut at line feeds."""
    return table.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def tokenise(lines: DataFrame, *key: str, digits: bool = False) -> DataFrame:
    """key, pos, word: lower-cased tokens with their positions in the line."""
    words = t.tokens(t.lower_ascii(F.col("line")))
    if digits:
        words = F.transform(words, t.normalise_digits)
    return lines.select(*key, F.posexplode(words).alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    """word: the lower-cased tokens of whole texts, of which nobody asks for line or place. A line feed is white space, so
    they are those of the lines; one explode, and no array is filtered."""
    split = F.split(t.lower_ascii(F.col(column)), t.SPACE)
    return texts.select(F.explode(split).alias("word")).where("word <> ''")


def ngram_records(lines: DataFrame) -> DataFrame:
    """word, match_count: the five tokens of each record of exactly 8 fields, without part-of-speech suffixes."""
    fields = F.split(t.lower_ascii(F.col("line")), "[ \t]+")
    records = lines.select(fields.alias("f")).where(F.size("f") == 8)
    records = records.select(F.explode(F.slice("f", 1, 5)).alias("word"), t.integer_prefix(F.get("f", F.lit(6))).alias("match_count"))
    return records.select(t.strip_pos(F.col("word")).alias("word"), "match_count")


def dictionary_words(lines: DataFrame) -> DataFrame:
    """word: every distinct token of a dictionary."""
    return lines.select(F.explode(t.tokens(t.lower_ascii(F.col("line")))).alias("word")).distinct()


def questions(lines: DataFrame, *key: str) -> DataFrame:
    """key, target, candidates, answer of lines ``target: c1 c2 c3 c4 c5 :: answer``; a malformed line has
    null target, candidates and answer."""
    words = t.tokens(t.lower_ascii(F.col("line")))
    w = F.col("w")
    good = (F.size("w") == 8) & (F.get(w, F.lit(6)) == "::")
    return lines.select(*key, words.alias("w")).select(
        *key,
        F.when(good, F.expr("left(w[0], length(w[0]) - 1)")).alias("target"),
        F.when(good, F.slice("w", 2, 5)).alias("candidates"),
        F.when(good, F.get(w, F.lit(7))).alias("answer"),
    )


def vector_lines(lines: DataFrame, with_id: bool = False) -> DataFrame:
    """id, word, bias, grad, vec of lines (line_no, line) ``word v1 ... vd``, or with_id ``word id bias gram v1 ... vd``
    after a header line. Words are lower-cased; the first line of a word counts; ids are dense in line order."""
    rows = lines.where(F.col("line_no") > F.lit(0)) if with_id else lines
    rows = rows.select("line_no", t.tokens(F.col("line")).alias("f")).where(F.size("f") > 0)
    first = 5 if with_id else 2
    word = t.lower_ascii(F.get("f", F.lit(0)))
    bias = F.get("f", F.lit(2)).cast("double") if with_id else F.lit(0.0)
    vec = F.transform(F.slice("f", first, F.size("f")), lambda x: x.cast("double"))
    rows = rows.select("line_no", word.alias("word"), bias.alias("bias"), vec.alias("vec"))
    kept = rows.groupBy("word").agg(F.min_by(F.struct("line_no", "bias", "vec"), "line_no").alias("r")).select("word", "r.*")
    return number_lines(kept, "line_no", "id").select("id", "word", "bias", F.lit(0.0).alias("grad"), "vec")
