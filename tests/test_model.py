import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from antipode.operators import evaluation, similarity, training, updates
from antipode.operators import heavy_hitters as heavy_hitters_module
from antipode.operators.heavy_hitters import SpaceSaving, heavy_hitters
from antipode.sources import corpus, storage
from antipode.streaming import word_counts


def model_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, word string, bias double, grad double, vec array<double>")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=60), st.integers(1, 6))
def test_space_saving_bounds(stream, counters):
    sketch = SpaceSaving(counters)
    for w in stream:
        sketch.add(w)
    true = Counter(stream)
    assert sum(sketch.count.values()) == len(stream)
    for w, n in sketch.count.items():
        assert true[w] <= n <= true[w] + sketch.epsilon[w]


def test_space_saving_replaces_the_oldest():
    sketch = SpaceSaving(2)
    for w in "abc":
        sketch.add(w)
    assert sketch.count == {"b": 1.0, "c": 2.0} and sketch.epsilon["c"] == 1.0


def test_heavy_hitters(spark):
    rnd = random.Random(1)
    words = [f"w{min(rnd.randint(0, 60), rnd.randint(0, 60))}" for _ in range(3000)]
    found = heavy_hitters(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), 20).collect()
    true = Counter(words)
    assert found and all(r["count"] - r["epsilon"] <= true[r["word"]] <= r["count"] for r in found)


def test_questions(spark):
    lines = spark.createDataFrame(
        [(1, "a: b c b c b :: c"), (2, "zz: b c b c b :: c"), (3, "a: b c b c zz :: c"), (4, "a: c b d b b :: d"), (5, "a: b b d d d :: d"), (6, "")], "qid bigint, line string"
    )
    model = model_of(spark, [(0, "a", 0.0, 0.0, [1.0, 0.0]), (1, "b", 0.0, 0.0, [-1.0, 0.0]), (2, "c", 0.0, 0.0, [1.0, 1.0]), (3, "d", 0.0, 0.0, [-1.0, 5.0])])
    asked = corpus.questions(lines, "qid")
    answers = evaluation.question_answers(asked, evaluation.question_scores(asked, model))
    assert sorted((r.qid, r.chosen, r.correct) for r in answers.collect()) == [(1, "b", False), (4, "b", False), (5, "b", False)]
    row = evaluation.metrics(asked, answers).first()
    assert (row.total, row.answered, row.correct, row.precision, row.f) == (6, 3, 0, 0.0, None)


def test_similar_unknown_and_zero_vectors(spark):
    model = model_of(spark, [(0, "a", 0.0, 0.0, [1.0, 0.0]), (1, "b", 0.0, 0.0, [1.0, 0.0]), (2, "c", 0.0, 0.0, [0.0, 0.0])])
    rows = similarity.similar_words(spark.createDataFrame([("a",), ("?",)], "query string"), model, 2).collect()
    assert sorted((r["query"], r["rank"], r["word"]) for r in rows) == [("?", 1, "unknown"), ("?", 2, "unknown"), ("a", 1, "b"), ("a", 2, "c")]
    pairs = spark.createDataFrame([(0, 2)], "a bigint, b bigint")
    assert similarity.pair_similarity(pairs, model).first()["cosine"] is None
    lines = spark.createDataFrame([(1, "a a b"), (2, "? ?"), (3, "")], "s bigint, line string")
    vecs = {r.s: r.vec for r in similarity.sentence_vectors(lines, corpus.tokenise(lines, "s"), model, "s").collect()}
    assert vecs == {1: [3.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def toy(spark):
    rng = np.random.default_rng(0)
    model = model_of(spark, [(i, f"w{i}", 0.0, 0.0, (rng.random(4) - 0.5).tolist()) for i in range(12)])
    rows = [(int(a), int(b), 100.0, 0.0, "syn") for a, b in ((0, 1), (2, 3), (4, 5))] + [(int(a), int(b), 0.0, 320.0, "ant") for a, b in ((6, 7), (8, 9))]
    rows += [(b, a, p, n, o) for a, b, p, n, o in rows]
    return model, spark.createDataFrame(rows, "w1 bigint, w2 bigint, pos double, neg double, origin string")


def replay(model, rows, seed, epoch):
    """The sequential rule, written from its definition."""
    words = {r["id"]: [np.array(r["vec"]), r["bias"], r["grad"]] for r in model.collect()}
    rows = sorted((r["w1"], r["w2"], r["origin"], r["pos"], r["neg"]) for r in rows.collect())
    cost = 0.0
    for k in np.random.default_rng([seed, epoch, 0]).permutation(len(rows)):
        a, b, _, pos, neg = rows[k]
        x, y = words[a], words[b]
        q = 1 / (1 + math.exp(-(x[0] @ y[0] + y[1])))
        cost -= pos * math.log(q) + neg * math.log(1 - q)
        diff = pos * (1 - q) - neg * q
        old = x[0].copy()
        x[2] += y[0] @ y[0] / 5 * diff**2
        x[0] = x[0] + 0.03 * diff / math.sqrt(x[2]) * y[0]
        y[2] += (old @ old + 1) / 5 * diff**2
        y[0] = y[0] + 0.03 * diff / math.sqrt(y[2]) * old
        y[1] += 0.03 * diff / math.sqrt(y[2])
    return words, cost


def test_one_task_is_the_sequential_rule(spark):
    model, rows = toy(spark)
    after, cost, changes = training.train_epoch(model, rows, tasks=1, seed=3, epoch=2)
    words, expected = replay(model, rows, 3, 2)
    assert changes == 10 and abs(cost - expected) < 1e-9
    for r in after.collect():
        vec, bias, grad = words[r["id"]]
        assert np.allclose(r["vec"], vec) and abs(r["bias"] - bias) < 1e-12 and abs(r["grad"] - grad) < 1e-9


def test_training_separates(spark):
    model, rows = toy(spark)
    after, costs = training.train(model, rows, epochs=6, tasks=2)
    assert costs[-1] < costs[0]
    score = {(r.a, r.b): r.similarity for r in similarity.pair_similarity(spark.createDataFrame([(0, 1), (2, 3), (6, 7), (8, 9)], "a bigint, b bigint"), after).collect()}
    assert max(score[6, 7], score[8, 9]) < min(score[0, 1], score[2, 3])
    assert training.reset_history(after).first()["grad"] == 1e-12


def test_implicit_negatives_take_a_rank_prefix(spark):
    vocab = spark.createDataFrame([(i, f"w{i}", float(c), False) for i, c in enumerate((50, 20, 20, 5, 1))], "id bigint, word string, count double, is_dict boolean")
    cooc = spark.createDataFrame([(0, 1, 30.0), (1, 0, 30.0), (3, 3, 2.0)], "w1 bigint, w2 bigint, count double")
    stats = updates.word_stats(vocab, cooc, 1.0)
    none = spark.createDataFrame([], "a bigint, b bigint, kind string")
    pairs = {(r.w1, r.w2) for r in updates.implicit_negatives(cooc, stats, none).collect()}
    # Never the last-ranked word, never an observed pair; a word may be its own negative.
    assert all(w2 != 4 for _, w2 in pairs) and not pairs & {(0, 1), (1, 0), (3, 3)}
    eligible = {r.w1: r.m for r in updates.eligible(stats).collect()}
    weights = sorted((r.neg_w for r in stats.collect()), reverse=True)
    for r in stats.collect():
        if r.scale:
            assert eligible[r.id] == min(sum(w >= 1e-5 / r.scale for w in weights), 4)


def test_binary_formats(spark, tmp_path):
    data = storage.pack_vocabulary([("a", 3.0), ("é", 2.0), ("b", 2.0)], 9.0)
    assert storage.unpack_vocabulary(data) == (7.0, [("a", 3.0), ("é", 2.0), ("b", 2.0)])
    rows = [(1, 0.5, 0.1, [1.0, 2.0]), (0, 0.0, 0.0, [3.0, 4.0])]
    assert storage.unpack_model(storage.pack_model(rows, 7, 2)) == (7, sorted(rows))
    (tmp_path / "c.bin").write_bytes(struct.pack("=iid", 1, 2, 0.5) + struct.pack("=iid", 2, 1, 0.25))
    found = storage.read_cooccurrence_files(spark, str(tmp_path / "c.bin"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 0.5), (2, 1, 0.25)]


def test_text_model(spark, tmp_path):
    model = model_of(spark, [(0, "a", 0.5, 0.0, [1.0, 2.0])])
    storage.save_text_model(model, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m/header")).collect()] == ["2 1"]
    assert [r.value for r in spark.read.text(str(tmp_path / "m/words")).collect()] == ["a 1.0 2.0 0.5"]
    lines = spark.createDataFrame([(0, "header"), (1, "A 0 0.5 0.0 1.0 2.0"), (2, "a 1 0.7 0.0 3.0 4.0")], "line_no bigint, line string")
    assert [(r.id, r.word, r.bias, r.vec) for r in corpus.vector_lines(lines, with_id=True).collect()] == [(0, "a", 0.5, [1.0, 2.0])]


def random_updates(rnd, words, n):
    rows = {(rnd.randrange(words), rnd.randrange(words)) for _ in range(n)}
    return [(a, b, rnd.choice([0.0, 1.0, 2.5]), rnd.choice([0.0, 1.0, 300.0]), "observed") for a, b in sorted(rows)]


def test_updates_in_turns_are_those_one_after_the_other():
    rnd, rng = random.Random(4), np.random.default_rng(4)

    class OneByOne(training.SymmetricWords):
        learn_many = property()  # hasattr is false

    for words, n in ((1, 4), (5, 60), (40, 500)):
        rows = random_updates(rnd, words, n)
        rnd.shuffle(rows)
        a, b, pos, neg = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
        start = rng.normal(size=(words, 6)), rng.normal(size=words), np.zeros(words)
        results = []
        for kind in (training.SymmetricWords, OneByOne):
            own = kind(*start)
            results.append((own, *training.run_updates(own, a, b, pos, neg, words)))
        (x, cost, changes, touched), (y, cost_y, changes_y, touched_y) = results
        assert np.isclose(cost, cost_y) and changes == changes_y and (touched == touched_y).all()
        assert np.allclose(x.vec, y.vec) and np.allclose(x.bias, y.bias) and np.allclose(x.grad, y.grad)
        turn = training.turns(a, b, words)
        for t in set(turn.tolist()):
            met = [w for k in np.flatnonzero(turn == t) for w in {a[k], b[k]}]
            assert len(met) == len(set(met))


def test_blocks_meet_once():
    for blocks in (2, 4, 10):
        seen = set()
        for groups in training._rounds(blocks)[1:]:
            assert set(groups) == set(range(blocks)) and len(set(groups.values())) == blocks // 2
            seen |= {(x, y) for x in groups for y in groups if x < y and groups[x] == groups[y]}
        assert len(seen) == blocks * (blocks - 1) // 2


def test_training_by_blocks(spark, monkeypatch):
    rnd, rng = random.Random(6), np.random.default_rng(6)
    rows = random_updates(rnd, 30, 300)
    model = model_of(spark, [(i, f"w{i}", 0.0, 0.0, rng.normal(size=4).tolist()) for i in range(31)])
    updates = spark.createDataFrame(rows, "w1 bigint, w2 bigint, pos double, neg double, origin string")
    # One block of all words: the sequential rule in the block's order.
    after, cost, changes = training.train_epoch_blocks(model, updates, blocks=4, seed=1)
    own = {r["id"]: r for r in after.collect()}
    assert len(own) == 31 and own[30]["grad"] == 0.0 and changes == sum((p or n) > 0 for _, _, p, n, _ in rows)
    before = {r["id"]: (np.array(r["vec"]), 0.0) for r in model.collect()}

    def total(state):
        out = 0.0
        for a, b, p, n, _ in rows:
            q = 1 / (1 + np.exp(-(state[a][0] @ state[b][0] + state[b][1])))
            out -= p * np.log(q) + n * np.log(1 - q)
        return out

    assert total({i: (np.array(r["vec"]), r["bias"]) for i, r in own.items()}) < total(before)
    again = {r["id"]: r["vec"] for r in training.train_epoch_blocks(model, updates.repartition(5), blocks=3, seed=1)[0].collect()}
    assert all(again[i] == own[i]["vec"] for i in own)  # 3 is made 4, and order of arrival is of no account
    # A model beyond the bound takes that way.
    monkeypatch.setattr(training, "MODEL_BYTES", 31 * 6 * 8 // 2)
    big, big_cost, _ = training.train_epoch(model, updates, tasks=2, seed=1)
    assert np.isclose(big_cost, cost) and all(r["vec"] == own[r["id"]]["vec"] for r in big.collect())


def test_native_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BLOCK_ROWS", 3)
    words = [(0, "a", 5.0), (1, "éß", 2.0), (2, "c", 2.0), (3, "d", 1.0)]
    vocab = spark.createDataFrame(words, "id bigint, word string, count double").repartition(3)
    storage.write_vocabulary_file(vocab, str(tmp_path / "vocab"))
    data = (tmp_path / "vocab").read_bytes()
    assert data == storage.pack_vocabulary([(w, n) for _, w, n in words], 10.0)
    assert sorted(map(tuple, storage.read_vocabulary_file(spark, str(tmp_path / "vocab")).collect())) == words
    pairs = [(i % 7, i // 7, i / 3) for i in range(40)]
    storage.write_cooccurrence_file(spark.createDataFrame(pairs, "w1 bigint, w2 bigint, count double"), str(tmp_path / "cooc"))
    assert (tmp_path / "cooc").read_bytes() == b"".join(struct.pack("=iid", *p) for p in sorted(pairs))
    assert sorted(map(tuple, storage.read_cooccurrence_files(spark, str(tmp_path / "cooc")).collect())) == sorted(pairs)
    rows = [(i, 0.5 * i, 1e-3 * i, [float(i), -1.0, 2.0]) for i in range(8)]
    storage.write_model_file(model_of(spark, [(i, f"w{i}", b, g, v) for i, b, g, v in rows]), str(tmp_path / "model"), 7)
    found, epochs = storage.read_model_file(spark, str(tmp_path / "model"))
    assert epochs == 7 and sorted((r["id"], r["bias"], r["grad"], r["vec"]) for r in found.collect()) == rows
    assert storage.unpack_model((tmp_path / "model").read_bytes()) == (7, rows)
    for kind, write in (("vocab", storage.write_vocabulary_file), ("cooc", storage.write_cooccurrence_file)):
        empty = vocab.limit(0) if kind == "vocab" else spark.createDataFrame([], "w1 bigint, w2 bigint, count double")
        write(empty, str(tmp_path / f"empty-{kind}"))
    assert storage.read_vocabulary_file(spark, str(tmp_path / "empty-vocab")).count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())


def test_stream_summary_is_bounded(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(200)) for _ in range(12)]
    for k in range(3):  # three files, one trigger each at most
        spark.createDataFrame([(t,) for t in texts[4 * k : 4 * k + 4]], "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "texts"))
    found = word_counts.stream_heavy_hitters(spark, str(tmp_path / "texts"), 60).collect()
    true = Counter(w for t in texts for w in t.split())
    assert len(true) > 150 and len(found) == 60
    assert all(r["count"] - r["epsilon"] <= true[r["word"]] <= r["count"] for r in found)
    assert {w for w, _ in true.most_common(5)} <= {r["word"] for r in found}


def test_tasks_without_words_are_summarised(spark):
    tokens = spark.range(0, 40, 1, 4).where("id < 10").selectExpr("concat('w', id % 3) AS word")  # three of four tasks have none
    assert tokens.rdd.glom().map(len).collect() == [10, 0, 0, 0]
    found = {r["word"]: (r["count"], r["epsilon"]) for r in heavy_hitters(tokens, 5).collect()}
    assert found == {"w0": (4.0, 0.0), "w1": (3.0, 0.0), "w2": (3.0, 0.0)}
    assert heavy_hitters(tokens.where("word = ''"), 5).collect() == []


@pytest.mark.parametrize("words", [["b", "a", "b", "c", "b"], []])
def test_stream_summary_over_pieces_without_rows(spark, tmp_path, words):
    path, most = str(tmp_path / "texts"), "spark.sql.files.maxPartitionBytes"
    spark.createDataFrame([(" ".join(words),)] * 300, "text string").coalesce(1).write.parquet(path)  # one row group
    before = spark.conf.get(most)
    spark.conf.set(most, "200")  # many pieces, one of which has the row group
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() > 1
        found = {r["word"]: (r["count"], r["epsilon"]) for r in word_counts.stream_heavy_hitters(spark, path, 10).collect()}
    finally:
        spark.conf.set(most, before)
    assert found == {w: (300.0 * n, 0.0) for w, n in Counter(words).items()}


def test_summaries_merge_within_bounds(spark):
    rnd = random.Random(8)
    words = [[f"w{int(rnd.paretovariate(0.8))}" for _ in range(900)] for _ in range(3)]
    true = Counter(w for part in words for w in part)
    now = None
    for part in words:
        own = heavy_hitters_module.summaries(spark.createDataFrame([(w,) for w in part], "word string").repartition(2), 25)
        now = heavy_hitters_module.shortened(heavy_hitters_module.merged(own if now is None else own.unionByName(now)), 25).cache()
    rows = now.collect()
    least = next(r["least"] for r in rows if r["word"] is None)
    kept = {r["word"]: r for r in rows if r["word"] is not None}
    assert len(kept) <= 25
    for w, n in true.items():
        assert kept[w]["count"] - kept[w]["epsilon"] <= n <= kept[w]["count"] if w in kept else n <= least
