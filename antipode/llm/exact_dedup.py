"""Exact deduplication by exchanged fingerprints.

1. Documents are staged once, each scan partition as a sender, with a fingerprint and a SHA-256 per text.
2. Senders send sorted, Golomb-coded fingerprints to the owners of hash ranges, who answer whether other
   rows hold them (``exchange``). A sender's repeats count once, so a hot text costs one entry a sender.
3. Each sender turns the answers into a bitmap of *suspect* rows and joins it to its staged rows in place
   (the table is bucketed by sender; no text moves).
4. Only suspects are shuffled, grouped by their bytes. Equal texts meet as one row per task, because Spark
   sums before it shuffles; a fingerprint that two texts share is told apart there. Suspects then meet their group's
   row in a join by SHA-256, one small row a group; Spark's adaptive execution cuts the side of a hot text's rows.

Texts are equal when identical after no change. Of equal texts the row with the largest doc_id stays; of
rows that repeat that doc_id one stays. Null text counts as empty; a null doc_id is smaller than any. Empty
tables give no rows; other columns are carried by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import owners_of, row_id, stage, text_or_empty, written


def fingerprint(text):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - exchange.BITS)


def suspects(staged: DataFrame, owners: int) -> DataFrame:
    """sender, bitmap: per sender, a bit per row that is set if another row has the row's fingerprint."""

    def send(key, table):
        return exchange.message_table(exchange.message_rows(key[0].as_py(), table["_fp"].to_numpy().astype(np.uint64), owners))

    def mark(key, table, answers):
        import pyarrow as pa

        where = np.unique(table["_fp"].to_numpy().astype(np.uint64), return_inverse=True)[1]
        level = exchange.read_answers(list(zip(answers["owner"].to_pylist(), answers["values"].to_pylist(), strict=True)))
        docno = table["docno"].to_numpy()
        marks = np.zeros(int(docno.max()) + 1, np.uint8)
        marks[docno] = level[where] > 0
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], ["sender", "bitmap"])

    rows = staged.select("sender", "docno", "_fp")
    answers = exchange.answer(rows.groupBy("sender").applyInArrow(send, exchange.MESSAGE), owners)
    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark, "sender int, bitmap binary")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staged documents as doc, with _sha, _row and _suspect; one row per group of suspect copies: _sha, keep_id,
    _keep_row, group_size)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text_or_empty().alias("_text"))
    staged = stage(rows.select("doc", fingerprint("_text").alias("_fp"), F.unhex(F.sha2("_text", 256)).alias("_sha")), "exact")
    bitmaps = written(suspects(staged, owners_of(staged)), "suspects").hint("shuffle_hash")
    marked = staged.join(bitmaps, "sender").select("doc", "_sha", row_id().alias("_row"), exchange.bit(F.col("bitmap"), F.col("docno")).alias("_suspect"))
    found = marked.where("_suspect").select("_sha", "_row", "doc.doc_id", text_or_empty("doc.text").alias("_text")).groupBy("_text").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("_row", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("_keep_row"),
        F.count("*").alias("group_size"),
        F.first("_sha").alias("_sha"),
    )
    return marked, written(found.drop("_text"), "copies")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size long, kept boolean, text_sha256: one row per row of docs."""
    marked, found = groups(docs.select("doc_id", "text"))
    marked = marked.withColumn("doc_id", F.col("doc.doc_id"))
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    one = (F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    alone = marked.where(~F.col("_suspect")).select("doc_id", *one, sha)
    copies = marked.where("_suspect").select("doc_id", "_row", "_sha").join(found, "_sha")
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"), sha))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    marked, found = groups(docs)
    alone = marked.where(~F.col("_suspect")).select("doc")
    copies = marked.where("_suspect").join(found.select(F.col("_keep_row").alias("_row")), "_row", "left_semi")
    return alone.unionByName(copies.select("doc")).select("doc.*")
