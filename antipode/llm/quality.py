"""Quality by importance resampling.

A text's features are its words and marks and the pairs of neighbours, hashed into ``BUCKETS`` buckets. Two
generative models give each bucket a probability: the target's over documents labelled good, the raw one's
over all documents. A document's log importance weight is the sum over all its features of the log ratio,
divided by ``temperature`` (1: the weight itself). Adding Gumbel noise and taking the k largest keys samples k
documents without replacement in proportion to the weights.

Both models are sums of one array a task, added up in a tree of small groups; two passes over the documents, no
text is moved. The k-th largest key is found exactly by counting keys in ever finer bins, so nothing is sorted
or gathered as a whole.

Nulls: null or empty text has no features and weight 0. A null doc_id is kept and is never labelled.
Without labels the target is the raw model and the sample uniform. Repeated rows count each, and each has a
draw of its own; ties in keys go by doc_id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

BUCKETS = 1 << 16
#: Arrays that are added up in one group.
FAN_IN = 128
#: Repeats of a row that are numbered in one go.
REPEATS = 4096
PIECE = re.compile(r"\w+|[^\w\s]+")


class Features:
    """Bucket numbers of a text's words and neighbouring pairs."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _number(self, word: str) -> int:
        if len(self.known) >= 500_000:
            self.known.clear()
        number = zlib.crc32(word.encode())
        if len(word) <= 64:
            self.known[word] = number
        return number

    def __call__(self, text: str) -> np.ndarray:
        get, make = self.known.get, self._number
        words = PIECE.findall(text.lower())
        ids = np.fromiter((n if (n := get(w)) is not None else make(w) for w in words), np.uint64, len(words))
        one = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        two = ((ids[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (ids[1:] + np.uint64(0x165667B19E3779F9))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
        return np.concatenate([one, two]).astype(np.int64)


def model(docs: DataFrame, labels: DataFrame, sample_rows: int = 100_000) -> np.ndarray:
    """The log ratio of the target's to the raw model's probability of each bucket. The target is learned from at most
    sample_rows of the documents labelled good (those with the smallest hashes of doc_id), whose ids are broadcast;
    the raw model counts all documents."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(good), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        features, sums = Features(), np.zeros((2, BUCKETS))
        for batch in batches:
            for good, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.bincount(features(text), minlength=BUCKETS)
                sums[1] += found
                if good:
                    sums[0] += found
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], ["part", "sums"])

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(zlib.decompress(x.as_py())) for x in table["sums"])
        return pa.table([table["part"][:1], pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "sums"])

    parts = rows.mapInArrow(count, "part int, sums binary")
    for _ in range(2):  # what is left is one array for each FAN_IN^2 tasks
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(add, "part int, sums binary")
    sums = np.zeros((2, BUCKETS))
    for row in parts.select("sums").toLocalIterator():
        sums += np.frombuffer(zlib.decompress(row[0])).reshape(2, BUCKETS)
    if not sums[0].sum():
        return np.zeros(BUCKETS)
    # Buckets that the target lacks are as rare there as the raw model's smallest share allows.
    raw = (sums[1] + 1) / (sums[1].sum() + BUCKETS)
    mass = sums[0].sum()
    target = (sums[0] + BUCKETS * raw) / (mass + BUCKETS)
    return np.log(target) - np.log(raw)


def log_weight(found: np.ndarray, ratio: np.ndarray, temperature: float = 1.0) -> float:
    """The log ratio of the two models' probabilities of a document with these features."""
    return float(ratio[found].sum()) / temperature


def keys(docs: DataFrame, ratio: np.ndarray, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """doc_id, log_weight double, draw long: the draw is a hash of (seed, doc_id, text) with 52 bits."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches):
        import pyarrow as pa

        features, ratio = Features(), held.value
        for batch in batches:
            weights = [log_weight(features(t), ratio, temperature) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights, pa.float64()), batch.column("draw")], ["doc_id", "log_weight", "draw"])

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12).alias("draw"))
    return rows.mapInArrow(weigh, "doc_id long, log_weight double, draw long")


def noisy(rows: DataFrame) -> DataFrame:
    """doc_id, log_weight, key double: the log weight with Gumbel noise. Rows that repeat a draw (the same doc_id and
    text) are numbered from 0, and all but the first draw anew by their numbers; numbers are made in blocks, in
    as many tasks as it takes."""
    same = rows.groupBy("doc_id", "log_weight", "draw").agg(F.count("*").alias("n"))
    first = same.select("doc_id", "log_weight", "draw")
    blocks = same.where("n > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))).alias("block"))
    blocks = blocks.repartition("doc_id", "draw", "block")
    last = F.least(F.col("n"), (F.col("block") + 1) * REPEATS) - 1
    numbers = blocks.select("doc_id", "log_weight", "draw", F.explode(F.sequence(F.col("block") * REPEATS, last)).alias("k")).where("k > 0")
    repeats = numbers.select("doc_id", "log_weight", F.shiftrightunsigned(F.xxhash64("draw", "k"), 12).alias("draw"))
    uniform = (F.col("draw").cast("double") + 0.5) / F.lit(float(1 << 52))
    return first.unionByName(repeats).select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"))


def largest(rows: DataFrame, k: int, bins: int = 4096, small: int = 10_000) -> DataFrame:
    """The k rows with the largest key, ties by smallest doc_id. rows should be written: they are read a few times."""
    n, lo, hi = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= n:
        return rows
    above, inside = None, n  # rows over hi are in; those in [lo, hi] are still to be told apart
    taken = 0
    while inside > small and hi > lo:
        width = (hi - lo) / bins
        if lo + width == lo:
            break
        part = rows.where(F.col("key").between(lo, hi))
        number = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        counted = sorted(part.groupBy(number.alias("bin")).agg(F.count("*"), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, m, low, high in counted:
            if taken + m > k:
                lo, hi, inside = low, high, m
                break
            taken += m
        if taken == k:
            return rows.where(F.col("key") > hi)
    above = rows.where(F.col("key") > hi)
    edge = rows.where(F.col("key").between(lo, hi)).orderBy(F.desc("key"), "doc_id").limit(k - taken)
    return above.unionByName(edge)


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """doc_id, log_weight, key of the sampled documents: a share of all rows, by default the share of good ones among
    the labelled."""
    if fraction is None:
        said = labels.where("quality IS NOT NULL").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
        fraction = 1.0 if said is None else said
    rows = written(noisy(written(keys(docs, model(docs, labels), seed, temperature), "weights")), "keys")
    return largest(rows, int(np.ceil(rows.count() * fraction)))
