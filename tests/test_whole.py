"""Registered queries take whole inputs: no prefix, no fixed ids."""

import random
from collections import Counter

import numpy as np
import pytest
from test_model import replay

from antipode.operators import cooccurrence, similarity, training
from antipode.plans import catalogue


def test_whole_sentences_co_occur(spark):
    rnd = random.Random(2)
    lines = [[rnd.choice([None, 0, 1, 2, 3]) for _ in range(n)] for n in (0, 1, 21, 60, 200)]
    rows = [(s, i, w) for s, line in enumerate(lines) for i, w in enumerate(line)]
    encoded = spark.createDataFrame(rows, "s bigint, pos bigint, id bigint")
    for symmetric in (True, False):
        expected = Counter()
        for line in lines:
            for i, a in enumerate(line):
                for b in line[i + 1 :]:
                    if a is not None and b is not None:
                        expected[a, b] += 1
                        expected[b, a] += symmetric
        found = cooccurrence.sentence_cooccurrences(encoded, "s", symmetric=symmetric).collect()
        assert {(r["w1"], r["w2"]): r["count"] for r in found} == {k: n for k, n in expected.items() if n}


def test_the_whole_sentence_query_has_no_prefix(spark, tmp_path):
    words = [f"x{k}" for k in range(40)]
    spark.createDataFrame([(0, " ".join(words))], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalogue.QUERIES["cooc_sentence"](spark, str(tmp_path)).count() == 40 * 39


@pytest.fixture(scope="module")
def trainable(spark, sf):
    return catalogue._trainable(spark, sf)


def test_training_takes_every_word_and_update(spark, sf, trainable):
    model, rows = trainable
    ids = {r["id"] for r in catalogue.QUERIES["vocab_topn_ties"](spark, sf).collect()}
    assert {r["id"] for r in model.collect()} == ids and max(ids) >= 1000
    assert rows.count() == catalogue.QUERIES["update_table"](spark, sf).count()
    named = {i for r in rows.select("w1", "w2").distinct().collect() for i in r}
    for name in ("train_epoch", "train_resume"):
        after = {r["id"]: r["grad"] for r in catalogue.QUERIES[name](spark, sf).collect()}
        assert set(after) == ids and {i for i, g in after.items() if g > 0} == named


def test_training_of_fifty_words_is_the_sequential_rule(spark, trainable):
    model, rows = trainable
    rows = rows.where("w1 < 50 AND w2 < 50")
    # The replay is written for four dimensions.
    model = training.initial_model(model.where("id < 50"), 4)
    after, cost, _ = training.train_epoch(model, rows, tasks=1, seed=3, epoch=2)
    words, expected = replay(model, rows, 3, 2)
    assert abs(cost - expected) < 1e-6 * abs(expected)
    for r in after.collect():
        vec, bias, grad = words[r["id"]]
        assert np.allclose(r["vec"], vec) and np.isclose(r["bias"], bias) and np.isclose(r["grad"], grad)


def test_searches_take_every_twentieth_row(spark):
    sf = "/root/testdata/sf0.1"
    asked = {f"w{k}" for k in range(0, 2000, 20)}
    for name in ("similar_words", "dissimilar_words"):
        found = Counter(r["query"] for r in catalogue.QUERIES[name](spark, sf).collect())
        assert found == dict.fromkeys(asked, 10)
    model = catalogue._model(spark, sf)
    one, many = (similarity.similar_words(catalogue._asked(model), model, batch=b) for b in (1024, 40))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_steps_take_every_row(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["id"]: (np.array(r["vec"]), r["bias"]) for r in catalogue._model(spark, sf).collect()}
    cost, moved = 0.0, set()
    for a in range(0, len(rows), 2):
        q = 1 / (1 + np.exp(-(rows[a][0] @ rows[a + 1][0] + rows[a + 1][1])))
        pos = 1.0 if a % 4 == 0 else 0.0
        if 0 < q < 1:
            cost -= pos * np.log(q) + (1 - pos) * np.log(1 - q)
        if pos - q != 0:
            moved |= {a, a + 1}
    found = catalogue.QUERIES["model_cost"](spark, sf).first()
    assert len(rows) == 2000 and found["updates"] == len(moved) / 2 and abs(found["cost"] - cost) < 1e-3
    assert {r["id"] for r in catalogue.QUERIES["adagrad_step"](spark, sf).select("id").distinct().collect()} == moved


def test_dictionary_and_records_are_whole(spark, sf):
    vocab = catalogue._vocab(spark, sf)
    heads = {r["line"].split()[0] for r in catalogue._dictionary(vocab, "syn").collect()}
    words = {r["id"]: r["word"] for r in vocab.collect()}
    assert heads == {words[i] for i in words if i % 4 == 0 and i + 1 in words}
    lines = [len(r["line"].split()) for r in catalogue._sentences(spark, sf).collect()]
    assert catalogue._record_lines(spark, sf).count() == 2 * sum(max(0, n - 4) for n in lines)
