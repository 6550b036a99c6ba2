"""Word counts over a stream of texts: exact, with a state that grows with the words, or by a bounded summary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy_hitters
from ..sources import corpus
from ..sources.storage import is_folder, remove_at_exit, shared_dir, written


def text_stream(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """A stream of a Parquet table's texts: new files of the folder are read as they come."""
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(f"{column} string")
    return source.parquet(path) if is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(folder)


def running_word_counts(stream: DataFrame, column: str = "text") -> DataFrame:
    lines = stream.select(F.explode(F.split(F.col(column), "\n")).alias("line"))
    return corpus.tokenise(lines).groupBy("word").agg(F.count("*").cast("double").alias("count"))


def stream_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word, count after all files there are now. Counts are state in the shared folder; each trigger replaces
    the result table as a whole, so a trigger that runs twice leaves the same table."""
    at = f"{shared_dir(spark)}/antipode/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, at)
    latest = {}

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result-{number}")
        latest["path"] = f"{at}/result-{number}"

    counts = running_word_counts(text_stream(spark, path))
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    if "path" not in latest:
        return spark.createDataFrame([], "word string, count double")
    return spark.read.parquet(latest["path"])


def stream_heavy_hitters(spark: SparkSession, path: str, counters: int) -> DataFrame:
    """word, count, epsilon after all files there are now. Each trigger merges the summary of its words with the one
    before and keeps ``counters`` words, so neither state nor triggers grow with the words. A trigger's summary is
    made of the one with the number before, so a trigger that runs twice leaves the same."""
    at = f"{shared_dir(spark)}/antipode/summary-{uuid.uuid4().hex}"
    remove_at_exit(spark, at)
    latest = {}

    def store(batch: DataFrame, number: int) -> None:
        parts = written(heavy_hitters.summaries(batch, counters), "summaries")
        if number:
            parts = parts.unionByName(spark.read.parquet(f"{at}/summary-{number - 1}"))
        rows = heavy_hitters.shortened(written(heavy_hitters.merged(parts), "merged"), counters)
        rows.write.mode("overwrite").parquet(f"{at}/summary-{number}")
        latest["path"] = f"{at}/summary-{number}"

    lines = text_stream(spark, path).select(F.explode(F.split(F.col("text"), "\n")).alias("line"))
    query = corpus.tokenise(lines).writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    if "path" not in latest:
        return spark.createDataFrame([], "word string, count double, epsilon double")
    return spark.read.parquet(latest["path"]).where("word IS NOT NULL").select("word", "count", "epsilon")
