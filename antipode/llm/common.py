"""What the training-data operators share: tables, shared storage, per-process caches, staged senders.

Executors share no local folder, so everything that is written between stages lies under
``spark.checkpoint.dir``. Functions that run in Python workers are pickled by value, so executors need
no copy of this package.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local folder if
    the session is one machine (as in tests), and an error on a cluster, whose executors don't see such a folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="antipode-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/antipode/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends, or by ``release``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _held().append((None, path))


def _held() -> list[tuple[str | None, str]]:
    """(table's name or None, path) of what this driver wrote; outside the module, which travels to workers by value."""
    return sys.modules.setdefault("_antipode_written", types.ModuleType("_antipode_written")).__dict__.setdefault("paths", [])


def release(spark: SparkSession) -> None:
    """Drops all tables and folders that the operators wrote in this process. Results that weren't written elsewhere
    can't be read any more. Without a call, tables are dropped when the driver's Python ends and folders with its JVM."""
    held = _held()
    while held:
        name, path = held.pop()
        if name is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_tables() -> None:
    """A lasting catalogue keeps no tables of a driver that has ended."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for name, _ in _held():
        if name is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def cache(name: str, make):
    """One object per worker process, kept across tasks (functions pickled by value lose module globals). A worker has
    one such object at a time: what another operator left there goes first, so that memories don't add up."""
    held = sys.modules.setdefault("_antipode_process_cache", types.ModuleType("_antipode_process_cache"))
    if getattr(held, "name", None) != name:
        held.name = held.value = None
        trimmed(None)
        held.name, held.value = name, make()
    return held.value


def trimmed(result):
    """result, after the worker process has given memory that it no longer uses back to the system: workers
    outlive their tasks, and a task's arrays would stay counted against the executor."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
    return result


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- staged senders -------------------------------------------------------------------------------


def _int_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of ints (Murmur 3 with seed 42), by which rows go to buckets."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    k = turn(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).astype(np.int32)


def sender_numbers(senders: int, buckets: int) -> list[int]:
    """A number for each sender, so that sender k's hash is in bucket k modulo the buckets: the hash of 0, 1, 2, .. would
    leave a third of the buckets empty and put several senders in others."""
    each, n = -(-senders // buckets), 64 + 32 * senders
    while True:
        bucket = np.mod(_int_hash(np.arange(n)), buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets))
        if np.bincount(bucket, minlength=buckets).min() >= each:
            return [int(order[first[k % buckets] + k // buckets]) for k in range(senders)]
        n *= 2


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df once, each scan partition as one *sender*, so that later passes find a sender's rows
    in one task without moving them: the table is bucketed by ``sender``, a bucket a sender, and grouping or cogrouping
    by ``sender`` needs no exchange of it. Adds ``sender`` int and ``docno`` int (row in the sender, from 0)."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    senders = max(1, df.rdd.getNumPartitions())
    buckets = min(most, senders)
    rid = F.monotonically_increasing_id()
    numbers = F.split(F.lit(",".join(map(str, sender_numbers(senders, buckets)))), ",").cast("array<int>")
    part = F.shiftright("_rid", 33).cast("int")  # beyond senders only if the plan at run time has more partitions
    df = df.withColumn("_rid", rid).select(
        "*", F.coalesce(F.get(numbers, part), part + F.lit(1 << 29)).alias("sender"), F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("docno")
    ).drop("_rid")
    name = f"antipode_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/antipode/{name}"
    df.write.bucketBy(buckets, "sender").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    _remove_at_exit(spark, path)
    if not any(n for n, _ in _held()):
        atexit.register(_drop_tables)
    _held()[-1] = name, path
    return spark.table(name)


#: Bytes of a staged table on disk for which one owner answers.
BYTES_AN_OWNER = 16 << 20


def owners_of(staged: DataFrame) -> int:
    """How many hash ranges a staged table's fingerprints are dealt into: twice as many as there are shuffle
    partitions, and more for a table so large that a range would outgrow a task."""
    size = int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * tasks(staged.sparkSession), -(-size // BYTES_AN_OWNER))


def row_id():
    """A staged row's number, unique in the table."""
    return F.shiftleft(F.col("sender").cast("long"), 33).bitwiseOR(F.col("docno"))
