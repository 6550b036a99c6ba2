"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

A piece goes where the sum over residual gaps g of (number of open sequences with gap g) squared becomes
smallest: into an open sequence with a gap that is at least its length, or into a new one. Full sequences
don't count. Ties go to the smallest gap. Pieces are dealt, by a hash of their row, into shards of about
``SHARD`` pieces; a shard is packed in one task, longest pieces first, and the pieces of its unfilled
sequences are packed again as long as that saves sequences. What is still in unfilled sequences goes into
the next round, with as many fewer shards, until one shard holds it all. Where more than half of a shard's
pieces would go on (lengths that don't add up to full sequences), its fullest sequences are closed as they
are until half is left. So every task is bounded by ``SHARD`` pieces, every round has at most half of the
pieces of the one before, whatever the lengths, and every piece is placed.

Nulls: a null text is empty (one piece that holds the end id alone); a null doc_id is kept. Repeated rows
are packed each, an empty table gives none, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cache, text_or_empty, written

SHARD = 1 << 16
END_ID = 2


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """One row per piece: row_id long (of docs' row), doc_id, piece int, start, length, ids_crc32 long."""
    compiled = bpe.compile_tokenizer(tokenizer_path)

    def cut(batches):
        import struct
        import zlib

        import pyarrow as pa

        encode = cache(f"encoder_{hash(compiled['json'])}", lambda: bpe.Encoder(compiled))
        end = struct.pack("<I", end_id)
        for batch in batches:
            out = []
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text) + end
                n, start, k = len(ids) // 4, 0, 0
                stop = n % size or size if n > size else n
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    out.append((row_id, doc_id, k, start, stop - start, zlib.crc32(part)))
                    start, stop, k = stop, stop + size, k + 1
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Packs lengths in the given order; a list of the items' numbers for each sequence."""
    open_at = np.zeros(size + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    out: list[list[int]] = []
    never = 1 << 40
    for item, length in enumerate(lengths.tolist()):
        change = np.where(open_at[length:] > 0, 1 - 2 * open_at[length:], never)  # change[k]: into a gap of length + k
        change[-1] = 0  # a new sequence
        change[1:] += 2 * open_at[1 : size - length + 1] + 1
        gap = length + int(np.argmin(change))
        if gap == size:
            to = len(out)
            out.append([item])
        else:
            open_at[gap] -= 1
            to = waiting[gap].pop()
            out[to].append(item)
        if gap > length:
            open_at[gap - length] += 1
            waiting[gap - length].append(to)
    return out


def pack_shard(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Longest first; the items of unfilled sequences are packed again while that saves sequences."""

    def packed(items: np.ndarray) -> list[list[int]]:
        items = items[np.argsort(-lengths[items], kind="stable")]
        return [items[s].tolist() for s in sum_of_squares(lengths[items], size)]

    done: list[list[int]] = []
    rest = packed(np.arange(len(lengths)))
    while True:
        done += [s for s in rest if lengths[s].sum() == size]
        rest = [s for s in rest if lengths[s].sum() < size]
        again = packed(np.array([i for s in rest for i in s], np.int64)) if rest else []
        if len(again) >= len(rest):
            return done + rest
        rest = again


def _packer(size: int, round_no: int, last: bool):
    def packed(pdf):
        lengths = pdf["length"].to_numpy()
        found = pack_shard(lengths, size)
        fills = np.array([lengths[s].sum() for s in found])
        counts = np.array([len(s) for s in found])
        fullest = np.argsort(-fills, kind="stable")
        closed = np.empty(len(found), bool)
        closed[fullest] = 2 * (np.cumsum(counts[fullest]) - counts[fullest]) < len(lengths)
        out = pdf.iloc[np.concatenate(found)].drop(columns="_shard")
        out["sequence_id"] = (round_no << 54) | (int(pdf["_shard"].iloc[0]) << 20) | np.repeat(np.arange(len(found)), counts)
        out["offset"] = np.concatenate([np.cumsum(lengths[s]) - lengths[s] for s in found])
        out["_done"] = np.repeat((fills == size) | closed, counts) | last
        return out

    return packed


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long."""
    todo = written(pieces(docs, tokenizer_path, size, end_id), "pieces")
    columns = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
    # A full piece is a sequence of its own, numbered below 0.
    full = todo.where(F.col("length") == size).select(
        *columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    todo = todo.where(F.col("length") < size)
    n, round_no, parts = todo.count(), 0, [full]
    while n:
        shards = -(-n // shard)

        dealt = todo.withColumn("_shard", F.pmod(F.xxhash64("row_id", "piece", F.lit(round_no)), F.lit(shards)).cast("int"))
        schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, _done boolean"
        out = written(dealt.groupBy("_shard").applyInPandas(_packer(size, round_no, shards == 1), schema), f"packed-{round_no}")
        parts.append(out.where("_done").drop("_done"))
        todo = out.where(~F.col("_done")).select(*columns)
        n, round_no = (0 if shards == 1 else todo.count()), round_no + 1
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.drop("row_id")
