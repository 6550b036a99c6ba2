"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from compare import same  # noqa: E402
from test_duplicates import near_brute  # noqa: E402
from test_tokens import PATH, check_packing  # noqa: E402

from antipode.llm import decontaminate, queries, toxicity  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]


def holders(texts, items):
    """Numbers of the texts that hold one of the items (text, edit budget): all cells of all alignments. More marks stand
    between texts than any budget could bridge."""
    gap = max(k for _, k in items) + 1
    t = np.concatenate([np.frombuffer((x + "\0" * gap).encode("utf-32-le"), np.int32) for x in texts])
    size = np.array([len(x) + gap for x in texts])
    begin, at, found = np.cumsum(size) - size, np.arange(len(t) + 1, dtype=np.int32), set()
    for item, budget in items:
        row = np.zeros(len(t) + 1, np.int32)
        for i, c in enumerate(item, 1):
            new = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
            row = np.minimum.accumulate(np.concatenate([[i], new]).astype(np.int32) - at) + at
        found |= set(np.flatnonzero(np.minimum.reduceat(row[:-1], begin) <= budget).tolist())
    return found


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    toxic, exact, near, leaks, pack = (f for _, f in corpus_pipeline.STAGES)

    def ids(df):
        assert df.columns == columns
        return sorted(r.doc_id for r in df.collect())

    # Each stage on all documents, and all in a row, by brute force.
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def harmless(rows):
        out = []
        for i, t in rows:
            found = set()
            for word in re.findall(r"[^\W\d_]+", t.lower()):
                found |= {zlib.crc32(x.encode()) % toxicity.BUCKETS for x in [word + "$", *(word[:k] for k in (3, 4, 5, 6) if len(word) > k)]}
            if 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in found)))) < 0.3:
                out.append((i, t))
        return out

    def single(rows):
        last = {}
        for i, t in rows:
            last[t] = max(i, last.get(t, i))
        return [(i, t) for i, t in rows if last[t] == i]

    def apart(rows):
        names = {eval(r)[2] for r in near_brute(rows, 5, 80)}
        return [(i, t) for i, t in rows if i in names]

    index = decontaminate.Items(bench, decontaminate.Q, 0.08)

    items = [(decontaminate.normal(t), k) for (_, t), k in zip(bench, index.budget.tolist(), strict=True)]
    seen = {rows[n] for n in holders([decontaminate.normal(t) for _, t in rows], items)}

    def unseen(rows):
        return [r for r in rows if r not in seen]

    left = rows
    for stage, brute in ((toxic, harmless), (exact, single), (near, apart), (leaks, unseen)):
        assert ids(stage(spark, docs, sf)) == sorted(i for i, _ in brute(rows))
        before, left = left, brute(left)
        assert len(left) <= len(before)
    assert len(left) < len(rows)
    packed = corpus_pipeline.run(spark, sf).collect()
    check_packing(packed, left, Tokenizer.from_file(PATH), 1024)
