"""A toxicity classifier that is regularised by counterfactuals.

Features are the distinct lower-cased words of a text and their beginnings of 3 to 6 letters, hashed. The
model is a logistic regression with an L1 penalty, plus a counterfactual penalty over swaps of identity terms in
labelled sentences: the squared change of the score's logit is added to the loss. A labelled text that mentions a
term has it swapped for others of its list and for the list's neutral word. A text that mentions none gets mentions
for the purpose: in place of one of its words, chosen by hash, stands a term of a list, which is then swapped like
any other, so that the penalty acts in every fit and in the company of all kinds of words. So terms that only name a
group come to weigh alike, and like the neutral word, whatever other words share their beginnings, and neutral
mentions are not taken for attacks. ``swap_report`` measures what is left of the change on held-out rows.

Only text enters a score. The fit reads at most ``sample_rows`` labelled rows (those with the smallest
hashes of doc_id), which bounds the driver's memory: their hashed features are collected, never texts.
Scoring is one pass without a shuffle; the model is a table of at most 2^18 weights, mostly zero.

Nulls: null text is scored as the empty text; labelled rows with a null doc_id or label are not learned
from. A doc_id with several labels counts as toxic if any says so. Without labelled rows every score is
0. Repeated rows are scored each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cache, text_or_empty

BUCKETS = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
#: Lists of our own, of single words: terms that name a group, by what is swapped for what; the first is neutral.
IDENTITY_TERMS = (
    "person woman man girl boy gay lesbian transgender bisexual queer straight heterosexual homosexual".split(),
    "people women men girls boys gays lesbians immigrants refugees muslims christians jews hindus buddhists atheists".split(),
    "human black white asian african latino hispanic american mexican chinese indian arab european".split(),
    "religious muslim christian jewish hindu buddhist catholic protestant atheist sikh".split(),
    "old young elderly disabled blind deaf autistic".split(),
    "persona mujer hombre gitano judío musulmán cristiano negro blanco".split(),
    "personne femme homme juif musulman chrétien noir blanc arabe".split(),
    "mensch frau mann jude muslim christ schwarzer weißer türke".split(),
)


def word_features(word: str) -> set[int]:
    parts = {word + "$", *(word[:k] for k in (3, 4, 5, 6) if len(word) > k)}
    return {zlib.crc32(p.encode()) % BUCKETS for p in parts}


def features(words) -> set[int]:
    return set().union(*map(word_features, words))


def mentions(words: set[str], lists: int = 2) -> list[tuple[set[str], str, tuple[str, ...]]]:
    """(words, an identity term among them, its list): the terms that a text mentions, or else for some lists the text with
    a term of the list in the place of one of its words. Which ones is told by a hash of the words."""
    found = [(words, term, terms) for terms in map(tuple, IDENTITY_TERMS) for term in sorted(words.intersection(terms))]
    if found or not words:
        return found
    draw = zlib.crc32(" ".join(sorted(words)).encode())
    slot = sorted(words)[draw % len(words)]
    for k in range(lists):
        terms = tuple(IDENTITY_TERMS[(draw + k * 3) % len(IDENTITY_TERMS)])
        term = terms[1 + draw // 8 % (len(terms) - 1)]
        found.append((words - {slot} | {term}, term, terms))
    return found


def counterfactuals(words: set[str], swaps: int = 3) -> list[tuple[list[int], list[int]]]:
    """For each mention of an identity term: the features that a swap adds and those it takes away."""
    out, bases = [], {}
    for own_words, term, terms in mentions(words):
        rest = frozenset(own_words - {term})
        if rest not in bases:
            bases[rest] = features(rest)
        mine = word_features(term) - bases[rest]
        others = [t for t in terms[1:] if t != term]
        start = zlib.crc32(term.encode()) % len(others)
        for other in [terms[0], *(others[(start + k) % len(others)] for k in range(swaps))]:
            if other != term:
                its = word_features(other) - bases[rest]
                out.append((sorted(its - mine), sorted(mine - its)))
    return out


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memory: dict[str, tuple[int, ...]] = {}

    def logit(self, text: str) -> float:
        hits: set[int] = set()
        memory = self.memory
        for word in set(WORD.findall(text.lower())):
            found = memory.get(word)
            if found is None:
                found = tuple(f for f in word_features(word) if f in self.weights)
                if len(memory) >= 300_000:
                    memory.clear()
                if len(word) <= 64:
                    memory[word] = found
            if found:
                hits.update(found)
        return self.bias + sum(map(self.weights.__getitem__, sorted(hits)))

    def score(self, text: str) -> float:
        if self.bias == -np.inf:
            return 0.0
        return float(1 / (1 + np.exp(-min(max(self.logit(text), -500.0), 500.0))))


class Loss:
    """The loss of weights and bias without the L1 term, and its gradient. values holds the rows' features one after the
    other, at where each row begins and the last ends. Rows are taken in blocks, so temporaries stay small; swaps that
    change the same features are one, as often as they come."""

    def __init__(self, values: np.ndarray, at: np.ndarray, labels: np.ndarray, swaps: list, fairness: float):
        self.values, self.at, self.y, self.fairness = values, at, labels.astype(float), fairness
        counted = sorted(Counter((tuple(more), tuple(less)) for more, less in swaps if more or less).items())
        pairs = [(np.array(more + less, np.int64), np.r_[np.ones(len(more)), -np.ones(len(less))]) for (more, less), _ in counted]
        self.pairs, self.times = len(pairs), np.array([n for _, n in counted], float)
        self.swap_index = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        self.swap_sign = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0)
        self.swap_row = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        n, at = len(self.at) - 1, self.at
        loss, grad, missed = 0.0, np.zeros(len(w)), 0.0
        for a in range(0, n, 1024):
            b = min(n, a + 1024)
            index, y = self.values[at[a] : at[b]], self.y[a:b]
            row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at[a : b + 1]))
            z = np.clip(bias + np.bincount(row, w[index], b - a), -500, 500)
            miss = 1 / (1 + np.exp(-z)) - y
            loss += (np.logaddexp(0, z) - y * z).sum()
            grad += np.bincount(index, miss[row], len(w))
            missed += miss.sum()
        if self.pairs:
            change = np.bincount(self.swap_row, w[self.swap_index] * self.swap_sign, self.pairs)
            loss += self.fairness * (self.times * change @ change)
            grad += 2 * self.fairness * np.bincount(self.swap_index, (self.times * change)[self.swap_row] * self.swap_sign, len(w))
        return loss, grad, missed


def optimise(values: np.ndarray, at: np.ndarray, labels: np.ndarray, swaps: list, l1: float = 5.0, fairness: float = 1.0, rounds: int = 80) -> Model:
    """Proximal AdaGrad on the full sample; deterministic."""
    n = len(at) - 1
    if n == 0:
        return Model({}, -np.inf)
    y = labels.astype(float)
    if y.min() == y.max():
        return Model({}, float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))))
    loss = Loss(values, at, labels, swaps, fairness)
    w, bias, seen, seen_bias = np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean()))), np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        _, grad, missed = loss(w, bias)
        seen += grad * grad
        rate = 0.5 / np.sqrt(seen)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        seen_bias += missed**2
        bias -= 0.5 * missed / np.sqrt(seen_bias)
    kept = np.flatnonzero(w)
    return Model(dict(zip(kept.tolist(), w[kept].tolist(), strict=True)), float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, l1: float = 5.0, fairness: float = 1.0) -> Model:
    """Learns from at most sample_rows labelled rows outside the held-out quarter."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(WORD.findall(text.lower()))
                swaps = counterfactuals(words)
                out.append((doc_id, toxic, sorted(features(words)), [s[0] for s in swaps], [s[1] for s in swaps]))
            many = pa.list_(pa.list_(pa.int32()))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), many, many]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "toxic", "features", "more", "less"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    found = rows.mapInArrow(describe, "doc_id long, toxic int, features array<int>, more array<array<int>>, less array<array<int>>").toArrow()
    if not len(found):
        return optimise(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), [])
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    parts = [chunk[k].values.to_numpy() for chunk in found["features"].chunks for k in range(len(chunk))]
    parts = [parts[k] for k in order]
    at, values, toxic = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts), found["toxic"].to_numpy()[order]
    swaps = [s for more, less in zip(found["more"].to_pylist(), found["less"].to_pylist(), strict=True) for s in zip(more, less, strict=True)]
    del found, parts
    pyarrow.default_memory_pool().release_unused()
    return optimise(values, at, toxic, swaps, l1, fairness)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int"""
    weights, bias, name = model.weights, model.bias, f"toxicity_{uuid.uuid4().hex}"

    def scored(batches):
        import pyarrow as pa

        own = cache(name, lambda: Model(weights, bias))
        for batch in batches:
            s = [own.score(t) for t in batch.column("text").to_pylist()]
            told = [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *told], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, whatever their names."""
    weights, bias, name = model.weights, model.bias, f"toxicity_{uuid.uuid4().hex}"

    def keep(batches):
        import pyarrow as pa

        own = cache(name, lambda: Model(weights, bias))
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py() or "") < threshold for t in batch.column("doc").field("text")], pa.bool_()))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return rows.mapInArrow(keep, rows.schema).select("doc.*")


def swap_report(docs: DataFrame, model: Model) -> DataFrame:
    """swaps long, moved long, mean_change double, largest_change double: over all held-out rows, how many identity-term
    swaps there are, how many change the score at all, and the change of the score (0 to 1) that they make."""
    weights, bias = model.weights, model.bias

    def measured(batches):
        import pyarrow as pa

        own = Model(weights, bias)
        for batch in batches:
            changes = []
            for text in batch.column("text"):
                for words, term, terms in mentions(set(WORD.findall(text.as_py().lower()))):
                    told = own.score(" ".join(words))
                    changes += [abs(own.score(" ".join(words - {term} | {other})) - told) for other in terms if other != term]
            yield pa.RecordBatch.from_arrays([pa.array(changes, pa.float64())], ["change"])

    rows = docs.where(held_out(F.col("doc_id"))).select(text_or_empty().alias("text")).mapInArrow(measured, "change double")
    return rows.agg(F.count("*").alias("swaps"), F.count(F.when(F.col("change") > 0, 1)).alias("moved"), F.avg("change").alias("mean_change"), F.max("change").alias("largest_change"))
