"""Training of antonym-aware embeddings.

Without shared memory, an epoch is *local* stochastic gradient descent: updates are dealt over tasks, each
task runs the exact sequential rule over its share in a seeded order on its own copy of the model, and the
tasks' results are combined per word: values are averaged with the number of updates as weights, AdaGrad
histories grow by the sum of the tasks' growth. With one task that is the sequential rule itself. The
model goes to tasks as a broadcast of known size (words x (dim + 2) doubles, checked against
``MODEL_BYTES``); what a task returns is the words that it touched. Each epoch is written, so a run can be
resumed and lineage stays short.

A larger model is never gathered (``train_epoch_blocks``): words are dealt into blocks, and an epoch goes by rounds in
each of which every block meets one other, so that a task holds the words of two blocks alone, and the updates
between them are run by the sequential rule. Nothing is averaged then.

A task runs updates that share no word together, as arrays: each waits for the ones before it that share a word
with it and for no other, so the result is that of one after the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import uniform
from ..functions.vectors import sum_vectors
from ..sources.storage import written

RHO = 0.03
MODEL_BYTES = 2 << 30


#: Updates that a group of two blocks takes on average, when a model is trained by blocks.
GROUP_UPDATES = 4_000_000


def uniform_draw(dim: int, seed: int = 0):
    """The default initialiser: uniform in (-0.5 / dim, 0.5 / dim), by a hash of (seed, id, i)."""
    return lambda word, i: (uniform(seed, "init", word, i) - 0.5) / dim


def initial_model(vocab: DataFrame, dim: int, seed: int = 0, draw=None) -> DataFrame:
    """id, word, bias, grad, vec. draw(id, i) gives the column of component i (from 1) of a word; uniform without one."""
    draw = draw or uniform_draw(dim, seed)
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: draw(F.col("id"), i).cast("double"))
    return vocab.select("id", "word", F.lit(0.0).alias("bias"), F.lit(0.0).alias("grad"), vec.alias("vec"))


def reset_history(model: DataFrame) -> DataFrame:
    return model.withColumn("grad", F.lit(1e-12))


class SymmetricWords:
    """The trainable rows: one vector a word for both roles, a bias and an AdaGrad history. Another model
    is another class with ``score`` and ``learn``, and ``learn_many`` if it can take updates that share no row at once."""

    def __init__(self, vec: np.ndarray, bias: np.ndarray, grad: np.ndarray):
        self.vec, self.bias, self.grad = vec.copy(), bias.copy(), grad.copy()

    def score(self, a: int, b: int) -> float:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(self.vec[a] @ self.vec[b] + self.bias[b])))

    def _move(self, i: int, direction: np.ndarray, bias: float, scale: float) -> None:
        self.grad[i] += (direction @ direction + bias * bias) / (len(direction) + 1.0) * scale * scale
        if self.grad[i] > 0:
            step = RHO * scale / np.sqrt(self.grad[i])
            self.vec[i] += step * direction
            self.bias[i] += step * bias

    def learn(self, a: int, b: int, pos: float, neg: float) -> tuple[float, bool]:
        """(cost, was the model changed)"""
        q = self.score(a, b)
        cost = -(pos * np.log(q) + neg * np.log(1.0 - q)) if 0.0 < q < 1.0 else 0.0
        diff = pos * (1.0 - q) - neg * q
        if diff == 0.0:
            return cost, False
        before = self.vec[a].copy()
        self._move(a, self.vec[b], 0.0, diff)
        self._move(b, before, 1.0, diff)
        return cost, True


    def learn_many(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, np.ndarray]:
        """(cost, which changed the model) of updates of which no two share a row, and none has one row twice."""
        left, right = self.vec[a], self.vec[b]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            q = 1.0 / (1.0 + np.exp(-(np.einsum("ij,ij->i", left, right) + self.bias[b])))
            cost = np.where((q > 0.0) & (q < 1.0), -(pos * np.log(q) + neg * np.log(1.0 - q)), 0.0)
            diff = pos * (1.0 - q) - neg * q
            wide = left.shape[1] + 1.0
            self.grad[a] += np.einsum("ij,ij->i", right, right) / wide * diff * diff
            self.grad[b] += (np.einsum("ij,ij->i", left, left) + 1.0) / wide * diff * diff
            step_a = np.where(self.grad[a] > 0, RHO * diff / np.sqrt(self.grad[a]), 0.0)
            step_b = np.where(self.grad[b] > 0, RHO * diff / np.sqrt(self.grad[b]), 0.0)
        self.vec[a] += step_a[:, None] * right
        self.vec[b] += step_b[:, None] * left
        self.bias[b] += step_b
        return float(cost.sum()), diff != 0.0


def turns(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The earliest turn of each update: one after the latest turn before it of either of its rows."""
    last, out = [0] * size, []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        t = (last[x] if last[x] > last[y] else last[y]) + 1
        last[x] = last[y] = t
        out.append(t)
    return np.array(out, np.int64)


def run_updates(own, a: np.ndarray, b: np.ndarray, pos: np.ndarray, neg: np.ndarray, size: int) -> tuple[float, int, np.ndarray]:
    """(cost, changes, changes of each row) of running the updates in their order over own, a model's rows."""
    touched, cost = np.zeros(size, np.int64), 0.0
    if not hasattr(own, "learn_many"):
        changes = 0
        for x, y, p, n in zip(a.tolist(), b.tolist(), pos.tolist(), neg.tolist(), strict=True):
            c, moved = own.learn(x, y, p, n)
            cost += c
            if moved:
                changes += 1
                touched[x] += 1
                touched[y] += 1
        return cost, changes, touched
    turn = turns(a, b, size)
    order = np.argsort(turn, kind="stable")
    bounds = np.flatnonzero(np.diff(turn[order], prepend=0, append=1 << 60))
    changed = np.zeros(len(a), bool)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at = order[lo:hi]
        twice = at[a[at] == b[at]]
        for k in twice.tolist():
            c, changed[k] = own.learn(int(a[k]), int(b[k]), pos[k], neg[k])
            cost += c
        if len(twice):
            at = at[a[at] != b[at]]
        if len(at):
            c, changed[at] = own.learn_many(a[at], b[at], pos[at], neg[at])
            cost += c
    np.add.at(touched, a[changed], 1)
    np.add.at(touched, b[changed], 1)
    return cost, int(changed.sum()), touched


def _in_order(pdf, key: list[int]):
    """The updates in a seeded order that doesn't depend on how they came."""
    pdf = pdf.sort_values(["w1", "w2", "origin"])
    return pdf.iloc[np.random.default_rng(key).permutation(len(pdf))]


def _local(held, seed: int, epoch: int, rows=SymmetricWords):
    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        ids, vec, bias, grad = held.value
        parts = list(batches)
        if not parts:
            return
        pdf = _in_order(pd.concat(parts), [seed, epoch, TaskContext.get().partitionId()])
        a, b = np.searchsorted(ids, pdf["w1"].to_numpy()), np.searchsorted(ids, pdf["w2"].to_numpy())
        own = rows(vec, bias, grad)
        cost, changed, touched = run_updates(own, a, b, pdf["pos"].to_numpy(), pdf["neg"].to_numpy(), len(ids))
        at = np.flatnonzero(touched)
        yield pd.DataFrame(
            {
                "id": np.concatenate([ids[at], [-1]]),
                "n": np.concatenate([touched[at], [changed]]),
                "bias": np.concatenate([own.bias[at] * touched[at], [cost]]),
                "grad": np.concatenate([own.grad[at] - grad[at], [0.0]]),
                "vec": [*(own.vec[at] * touched[at][:, None]), np.zeros(vec.shape[1])],
            }
        )

    return run


def _rounds(blocks: int) -> list[dict[int, int]]:
    """An even number of blocks meet each other once: for each round, block -> group of two; and a round of each alone."""
    out = [{b: b for b in range(blocks)}]
    for r in range(blocks - 1):
        round_of = {blocks - 1: 0, r: 0}
        for k in range(1, blocks // 2):
            round_of[(r + k) % (blocks - 1)] = round_of[(r - k) % (blocks - 1)] = k
        out.append(round_of)
    return out


def _grouped(seeds: list[int], rows_of=SymmetricWords):
    def run(key, words, rows):
        """The words of a group after its updates; and, as id -1, the cost and the changes."""
        import pandas as pd

        if not len(words):
            return words[["id", "bias", "grad", "vec"]]
        words, pdf = words.sort_values("id"), _in_order(rows, [*seeds, int(key[0])])
        ids = words["id"].to_numpy()
        own = rows_of(np.stack(words["vec"].to_numpy()), words["bias"].to_numpy(), words["grad"].to_numpy())
        a, b = np.searchsorted(ids, pdf["w1"].to_numpy()), np.searchsorted(ids, pdf["w2"].to_numpy())
        cost, changed, _ = run_updates(own, a, b, pdf["pos"].to_numpy(), pdf["neg"].to_numpy(), len(ids))
        return pd.DataFrame({"id": np.append(ids, -1), "bias": np.append(own.bias, cost), "grad": np.append(own.grad, float(changed)), "vec": [*own.vec, np.zeros(0)]})

    return run


def train_epoch_blocks(model: DataFrame, updates: DataFrame, blocks: int, seed: int = 0, epoch: int = 0, rows_of=SymmetricWords) -> tuple[DataFrame, float, int]:
    """(the model after one epoch, cost, changes), by blocks of words; blocks is made even. A group is one task with the
    words of two blocks and their updates, and each round is written."""
    blocks += blocks % 2
    block = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(blocks)).cast("int")
    table = written(updates.select("w1", "w2", "pos", "neg", "origin", block("w1").alias("x"), block("w2").alias("y")), "updates")
    named = model.select("id", "word")
    now = written(model.select("id", "bias", "grad", "vec"), "block-model")
    cost, changes = 0.0, 0

    for number, groups in enumerate(_rounds(blocks)):
        group = F.create_map(*(F.lit(v) for pair in groups.items() for v in pair))
        here = (F.col("x") == F.col("y")) if number == 0 else (F.col("x") != F.col("y")) & (group[F.col("x")] == group[F.col("y")])
        own = now.withColumn("g", group[block("id")])
        asked = table.where(here).withColumn("g", group[F.col("x")])
        after = own.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(_grouped([seed, epoch, number], rows_of), "id bigint, bias double, grad double, vec array<double>")
        after = written(after, "block-model")
        said = after.where("id = -1").agg(F.sum("bias"), F.sum("grad")).first()
        cost, changes = cost + (said[0] or 0.0), changes + int(said[1] or 0)
        now = after.where("id >= 0")
    return written(named.join(now, "id").select("id", "word", "bias", "grad", "vec"), "model"), cost, changes


def train_epoch(model: DataFrame, updates: DataFrame, tasks: int, seed: int = 0, epoch: int = 0, rows_of=SymmetricWords) -> tuple[DataFrame, float, int]:
    """(the model after one epoch, cost, changes). Words without updates stay as they are. rows_of makes a task's
    trainable rows of (vec, bias, grad). A model beyond MODEL_BYTES is trained by blocks, of which two fit."""
    spark = model.sparkSession
    rows, dim = model.count(), len(model.select("vec").first()[0])
    if (size := rows * (dim + 2) * 8) > MODEL_BYTES:
        groups = -(-updates.count() // GROUP_UPDATES)
        return train_epoch_blocks(model, updates, max(2 * -(-size // MODEL_BYTES), 2 * int(np.ceil(groups**0.5))), seed, epoch, rows_of)
    table = model.select("id", "bias", "grad", "vec").orderBy("id").toArrow().combine_chunks()
    vec = table["vec"].combine_chunks().flatten().to_numpy().reshape(rows, dim)
    held = spark.sparkContext.broadcast((table["id"].to_numpy(), vec, table["bias"].to_numpy(), table["grad"].to_numpy()))
    # By a hash of the pair, not round robin: the same rows meet in a task on every retry.
    dealt = updates.select("w1", "w2", "pos", "neg", "origin").repartition(tasks, "w1", "w2")
    parts = written(dealt.mapInPandas(_local(held, seed, epoch, rows_of), "id bigint, n bigint, bias double, grad double, vec array<double>"), "epoch")
    said = parts.where("id = -1").agg(F.sum("bias"), F.sum("n")).first()
    moved = parts.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n"), (F.sum("bias") / F.sum("n")).alias("b"), F.sum("grad").alias("g"), sum_vectors("vec", dim).alias("v"))
    moved = moved.select("id", "b", "g", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    after = model.join(moved, "id", "left").select(
        "id", "word", F.coalesce("b", "bias").alias("bias"), (F.col("grad") + F.coalesce("g", F.lit(0.0))).alias("grad"), F.coalesce("v", "vec").alias("vec")
    )
    held_after = written(after, "model")
    held.unpersist()
    return held_after, float(said[0] or 0.0), int(said[1] or 0)


def train(model: DataFrame, updates: DataFrame, epochs: int, tasks: int, seed: int = 0, done: int = 0, rows_of=SymmetricWords) -> tuple[DataFrame, list[float]]:
    """(model, cost of each epoch). To resume, give the model and how many epochs it has had."""
    costs = []
    for epoch in range(done, done + epochs):
        model, cost, _ = train_epoch(model, updates, tasks, seed, epoch, rows_of)
        costs.append(cost)
    return model, costs


def adagrad_step(updates: DataFrame, model: DataFrame) -> DataFrame:
    """id, bias, grad, vec after one update of each pair, for pairs that share no word: in columns only."""
    from ..functions import vectors as v

    left = model.select(F.col("id").alias("w1"), F.col("vec").alias("e1"), F.col("grad").alias("g1"), F.col("bias").alias("b1"))
    right = model.select(F.col("id").alias("w2"), F.col("vec").alias("e2"), F.col("grad").alias("g2"), F.col("bias").alias("b2"))
    rows = updates.join(left, "w1").join(right, "w2")
    q = v.sigmoid(v.dot(F.col("e1"), F.col("e2")) + F.col("b2"))
    rows = rows.withColumn("q", q).withColumn("diff", F.col("pos") * (1 - F.col("q")) - F.col("neg") * F.col("q")).where("diff <> 0")
    wide = F.size("e1") + F.lit(1.0)
    square = F.col("diff") * F.col("diff")
    rows = rows.withColumn("g1", F.col("g1") + v.squared_norm(F.col("e2")) / wide * square)
    rows = rows.withColumn("g2", F.col("g2") + (v.squared_norm(F.col("e1")) + 1.0) / wide * square)
    step = lambda g: F.coalesce(F.try_divide(F.lit(RHO) * F.col("diff"), F.sqrt(F.col(g))), F.lit(0.0))
    rows = rows.withColumn("s1", step("g1")).withColumn("s2", step("g2"))
    one = F.struct(F.col("w1").alias("id"), F.col("b1").alias("bias"), F.col("g1").alias("grad"), v.axpy(F.col("e1"), F.col("s1"), F.col("e2")).alias("vec"))
    two = F.struct(F.col("w2").alias("id"), (F.col("b2") + F.col("s2")).alias("bias"), F.col("g2").alias("grad"), v.axpy(F.col("e2"), F.col("s2"), F.col("e1")).alias("vec"))
    return rows.select(F.explode(F.array(one, two)).alias("r")).select("r.*")


def model_cost(updates: DataFrame, model: DataFrame) -> DataFrame:
    """cost, updates: the log-likelihood cost of a table of updates, and how many would change the model."""
    from ..functions import vectors as v

    left = model.select(F.col("id").alias("w1"), F.col("vec").alias("e1"))
    right = model.select(F.col("id").alias("w2"), F.col("vec").alias("e2"), F.col("bias").alias("b2"))
    rows = updates.join(left, "w1").join(right, "w2").withColumn("q", v.sigmoid(v.dot(F.col("e1"), F.col("e2")) + F.col("b2")))
    changes = F.col("pos") * (1 - F.col("q")) - F.col("neg") * F.col("q") != 0
    return rows.agg(F.sum(v.cost_term(F.col("q"), F.col("pos"), F.col("neg"))).alias("cost"), F.count(F.when(changes, 1)).alias("updates"))
