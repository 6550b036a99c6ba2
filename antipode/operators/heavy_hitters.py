"""Space-Saving: the most frequent items with a bounded number of counters.

Summaries are tables (word, count, epsilon, least): the true count of a word lies between count - epsilon and count, and
of a word that the summary lacks at most at least. Summaries are merged by adding both bounds, a word that one
lacks with its least."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Words that a task counts before they go to its summary.
AHEAD = 1 << 18


class SpaceSaving:
    """Counters by count; of the smallest count the one that came to it first is replaced."""

    def __init__(self, counters: int):
        self.counters = counters
        self.count: dict[str, float] = {}
        self.epsilon: dict[str, float] = {}
        self.with_count: dict[float, OrderedDict] = {}
        self.least = 0.0

    def add(self, item: str, k: float = 1.0) -> None:
        if item in self.count:
            old = self.count[item]
            self._leave(item, old)
        elif len(self.count) < self.counters:
            old, self.epsilon[item] = 0.0, 0.0
        else:
            old = self.minimum()
            gone = next(iter(self.with_count[old]))
            self._leave(gone, old)
            del self.count[gone], self.epsilon[gone]
            self.epsilon[item] = old
        self.count[item] = old + k
        self.with_count.setdefault(old + k, OrderedDict())[item] = None
        self.least = min(self.least, old + k) if self.least in self.with_count else 0.0

    def _leave(self, item: str, count: float) -> None:
        del self.with_count[count][item]
        if not self.with_count[count]:
            del self.with_count[count]

    def minimum(self) -> float:
        """The smallest count; 0 while counters are free."""
        if len(self.count) < self.counters:
            return 0.0
        if self.least not in self.with_count:
            self.least = min(self.with_count)
        return self.least


def summaries(tokens: DataFrame, counters: int) -> DataFrame:
    """word, count, epsilon, least: a summary of each task's words, and a row without a word for its least count. Words
    are counted ahead in Arrow, so the summary is asked once for each distinct word of ``AHEAD``."""

    def summarise(batches):
        import pyarrow as pa

        sketch, ahead, size = SpaceSaving(counters), [], 0

        def take():
            for entry in pa.chunked_array(ahead).value_counts().to_pylist():
                sketch.add(entry["values"], float(entry["counts"]))

        for batch in batches:
            ahead.append(batch.column("word"))
            size += batch.num_rows
            if size >= AHEAD:
                take()
                ahead, size = [], 0
        if ahead:
            take()
        least = sketch.minimum()
        rows = {"word": list(sketch.count), "count": list(sketch.count.values()), "epsilon": [sketch.epsilon[w] for w in sketch.count], "least": [least] * len(sketch.count)}
        kinds = pa.schema([("word", pa.string()), ("count", pa.float64()), ("epsilon", pa.float64()), ("least", pa.float64())])
        # A task may have no words, as where its piece of a file holds no row group; nothing tells the kinds of empty columns then.
        yield pa.RecordBatch.from_pydict(rows, kinds)
        yield pa.RecordBatch.from_pylist([{"word": None, "count": least, "epsilon": 0.0, "least": least}], kinds)

    return tokens.select("word").mapInArrow(summarise, "word string, count double, epsilon double, least double")


def merged(parts: DataFrame) -> DataFrame:
    """word, count, epsilon, missed: summaries added up. missed bounds the count of a word that no summary has."""
    # A word that a full summary lacks may have come up to its least count there.
    missed = parts.where("word IS NULL").agg(F.coalesce(F.sum("least"), F.lit(0.0)).alias("missed"))
    words = parts.where("word IS NOT NULL").groupBy("word").agg(F.sum("count").alias("count"), F.sum("epsilon").alias("epsilon"), F.sum("least").alias("own"))
    slack = F.col("missed") - F.col("own")
    return words.crossJoin(F.broadcast(missed)).select("word", (F.col("count") + slack).alias("count"), (F.col("epsilon") + slack).alias("epsilon"), "missed")


def heavy_hitters(tokens: DataFrame, counters: int) -> DataFrame:
    """word, count, epsilon: every task summarises its words; summaries are written once and merged. Each task and the
    result hold at most ``counters`` words a task."""
    return merged(written(summaries(tokens, counters), "summaries")).drop("missed")


def shortened(summary: DataFrame, counters: int) -> DataFrame:
    """word, count, epsilon, least and a row without a word, like one task's summary: the words with the largest counts of
    a merged summary. What is left out is bounded by its largest count."""
    kept = summary.orderBy(F.desc("count"), "word").limit(counters)
    left = summary.select("count").orderBy(F.desc("count")).limit(counters + 1)
    least = summary.agg(F.coalesce(F.max("missed"), F.lit(0.0)).alias("missed")).crossJoin(left.agg(F.when(F.count("*") > counters, F.min("count")).otherwise(0.0).alias("next")))
    least = least.select(F.greatest("missed", "next").alias("least"))
    rows = kept.select("word", "count", "epsilon").crossJoin(F.broadcast(least))
    return rows.unionByName(least.select(F.lit(None).cast("string").alias("word"), F.col("least").alias("count"), F.lit(0.0).alias("epsilon"), "least"))
