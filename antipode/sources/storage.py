"""Tables and models on storage that driver and executors share; the binary and text file formats."""

from __future__ import annotations

import json
import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new local folder if the session is one machine (as in tests), and an
    error on a cluster, whose executors don't see such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="antipode-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.getFileStatus(where).isDirectory()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends."""
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/antipode/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


# --- models ---------------------------------------------------------------------------------------


def save_model(model: DataFrame, path: str, epochs: int) -> None:
    """Parquet rows, AdaGrad history and all, and the header as one row of JSON beside them."""
    spark = model.sparkSession
    model.select("id", "word", "bias", "grad", "vec").write.mode("overwrite").parquet(f"{path}/words")
    dim = model.select(F.size("vec")).first()
    header = json.dumps({"epochs": epochs, "dim": dim[0] if dim else 0})
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(model, epochs it has had)"""
    return spark.read.parquet(f"{path}/words"), json.loads(spark.read.text(f"{path}/header").first()[0])["epochs"]


def text_model(model: DataFrame) -> DataFrame:
    """value: ``word v1 ... vd bias`` lines."""
    return model.select(F.concat_ws(" ", F.col("word"), F.transform("vec", lambda x: x.cast("string")), F.col("bias").cast("string")).alias("value"))


def save_text_model(model: DataFrame, path: str) -> None:
    """A header part ``dim size``, and the words' lines in parts beside it."""
    spark = model.sparkSession
    dim = model.select(F.size("vec")).first()
    spark.createDataFrame([(f"{dim[0] if dim else 0} {model.count()}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    text_model(model).write.mode("overwrite").text(f"{path}/words")


# --- native binary files, for exchange with other programs --------------------------------------------
#
# Each format is one sequential file, so its bytes are packed by tasks and pass through the driver in order, a block
# at a time. Files are read whole by a task each; large data comes as several files.

#: Rows of one packed block.
BLOCK_ROWS = 1 << 16


def _write_bytes(spark: SparkSession, path: str, blocks) -> None:
    """Writes byte blocks one after the other to a new file on any storage that Spark knows."""
    fs, where = _filesystem(spark, path)
    out = fs.create(where, True)
    try:
        for block in blocks:
            out.write(bytearray(block))
    finally:
        out.close()


def _packed_rows(df: DataFrame, columns: list[str], kinds: list[tuple[str, str]]):
    """The rows in df's order as fixed-size records, in blocks of bytes."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = np.zeros(batch.num_rows, np.dtype(kinds))
            for (name, *_), column in zip(kinds, batch.columns, strict=True):
                values = column.flatten() if pa.types.is_list(column.type) else column
                rows[name] = values.to_numpy(zero_copy_only=False).reshape(rows[name].shape)
            for a in range(0, len(rows), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([rows[a : a + BLOCK_ROWS].tobytes()], pa.binary())], ["block"])

    return (bytes(r[0]) for r in df.select(*columns).mapInArrow(pack, "block binary").toLocalIterator())


def write_vocabulary_file(vocab: DataFrame, path: str) -> None:
    """The words in descending order of count as ``double total``, then for each count ``int32 n, double count,
    n x {int16 length, bytes}``. Words of equal count come in the order of their ids."""
    spark = vocab.sparkSession
    total = vocab.agg(F.sum("count")).first()[0] or 0.0
    rows = vocab.orderBy(F.desc("count"), "id").select("word", "count").toLocalIterator()
    _write_bytes(spark, path, vocabulary_blocks(((r[0], r[1]) for r in rows), total))


def vocabulary_blocks(rows, total: float):
    """rows: (word, count) in descending order of count."""
    yield struct.pack("=d", total)
    group, now = [], None
    for word, count in rows:
        if count != now and group:
            yield struct.pack("=id", len(group), now) + b"".join(group)
            group = []
        now, word = count, word.encode()
        group.append(struct.pack("=h", len(word)) + word)
    if group:
        yield struct.pack("=id", len(group), now) + b"".join(group)


def pack_vocabulary(rows, total: float) -> bytes:
    return b"".join(vocabulary_blocks(rows, total))


def unpack_vocabulary(data: bytes) -> tuple[float, list[tuple[str, float]]]:
    """(total of the file's words, (word, count) in file order); the header's own total is not used."""
    at, rows = 8, []
    while at < len(data):
        n, count = struct.unpack_from("=id", data, at)
        at += 12
        for _ in range(n):
            (size,) = struct.unpack_from("=h", data, at)
            rows.append((data[at + 2 : at + 2 + size].decode(), count))
            at += 2 + size
    return sum(c for _, c in rows), rows


def read_vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """id, word, count: ids in the order of the file."""

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                _, rows = unpack_vocabulary(content)
                if rows:
                    yield pd.DataFrame({"id": range(len(rows)), "word": [w for w, _ in rows], "count": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "id bigint, word string, count double")


def pack_model(rows, epochs: int, dim: int) -> bytes:
    """rows: (id, bias, grad, vec). ``int32 epochs, dim, size``, then ``int32 id, double bias, grad, dim x double``."""
    rows = list(rows)
    body = b"".join(struct.pack(f"=i{dim + 2}d", i, bias, grad, *vec) for i, bias, grad, vec in rows)
    return struct.pack("=3i", epochs, dim, len(rows)) + body


def unpack_model(data: bytes) -> tuple[int, list[tuple[int, float, float, list[float]]]]:
    epochs, dim, size = struct.unpack_from("=3i", data)
    step = struct.calcsize(f"=i{dim + 2}d")
    rows = (struct.unpack_from(f"=i{dim + 2}d", data, 12 + k * step) for k in range(size))
    return epochs, sorted((r[0], r[1], r[2], list(r[3:])) for r in rows)


def write_model_file(model: DataFrame, path: str, epochs: int) -> None:
    first = model.select(F.size("vec")).first()
    dim = first[0] if first else 0
    kinds = [("id", "=i4"), ("bias", "=f8"), ("grad", "=f8"), ("vec", "=f8", (dim,))]
    blocks = _packed_rows(model, ["id", "bias", "grad", "vec"], kinds)
    _write_bytes(model.sparkSession, path, (b for part in ([struct.pack("=3i", epochs, dim, model.count())], blocks) for b in part))


def read_model_file(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(id, bias, grad, vec; epochs it has had). Rows are read in blocks, and none is named: words come from the vocabulary."""

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                _, dim, size = struct.unpack_from("=3i", content)
                kind = np.dtype([("id", "=i4"), ("bias", "=f8"), ("grad", "=f8"), ("vec", "=f8", (dim,))])
                for a in range(0, size, BLOCK_ROWS):
                    rows = np.frombuffer(content, kind, min(BLOCK_ROWS, size - a), 12 + a * kind.itemsize)
                    yield pd.DataFrame({"id": rows["id"].astype(np.int64), "bias": rows["bias"], "grad": rows["grad"], "vec": list(rows["vec"])})

    files = spark.read.format("binaryFile").load(path)
    header = bytes(files.select(F.substring("content", 1, 12).alias("header")).first()[0])
    rows = files.select("content").mapInPandas(unpack, "id bigint, bias double, grad double, vec array<double>")
    return rows, struct.unpack("=3i", header)[0]


def write_cooccurrence_file(cooc: DataFrame, path: str) -> None:
    """Packed ``{int32 w1, int32 w2, double count}`` in the order of (w1, w2)."""
    kinds = [("w1", "=i4"), ("w2", "=i4"), ("count", "=f8")]
    _write_bytes(cooc.sparkSession, path, _packed_rows(cooc.orderBy("w1", "w2"), ["w1", "w2", "count"], kinds))


def read_cooccurrence_files(spark: SparkSession, path: str) -> DataFrame:
    """w1, w2, count of files of packed ``{int32 w1, int32 w2, double count}``; a file is one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches):
        import numpy as np
        import pandas as pd

        kind = np.dtype([("w1", "=i4"), ("w2", "=i4"), ("count", "=f8")])
        for pdf in batches:
            for content in pdf["content"]:
                rows = np.frombuffer(content, kind)
                for a in range(0, len(rows), BLOCK_ROWS):
                    part = rows[a : a + BLOCK_ROWS]
                    yield pd.DataFrame({"w1": part["w1"].astype(np.int64), "w2": part["w2"].astype(np.int64), "count": part["count"]})

    return files.mapInPandas(unpack, "w1 bigint, w2 bigint, count double")
