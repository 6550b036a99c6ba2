import random
import re

import numpy as np
import pytest
from cases import EXTRA, ROWS, documents, empty
from pyspark.sql import functions as F

from antipode.llm import chat, decontaminate, licenses, quality, toxicity

# --- licences --------------------------------------------------------------------------------------------


def spelt(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def license_brute(rows):
    """(doc_id, template) where some window of the template's size holds 0.8 of its shingles."""
    out = set()
    for i, t in rows:
        own = spelt(t or "")
        for name, text in licenses.TEMPLATES.items():
            want = set(spelt(text))
            n = len(spelt(text))
            if any(len(want & set(own[max(0, a) : a + n])) >= 0.8 * len(want) for a in range(-n, len(own))):
                out.add((i, name))
    return out


@pytest.mark.parametrize("most", [20_000, 5])
def test_licenses(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_SHINGLES", most)
    rnd = random.Random(1)
    rows = list(ROWS)
    for k, (_, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = text.split()
        rows.append((100 + k, f"before it {text} and after"))
        rows.append((200 + k, "x " * rnd.randint(0, 90) + " ".join(w[: len(w) // 2])))
        if len(w) > 22:
            w[3] = "other"
            rows.append((300 + k, "y " * rnd.randint(0, 90) + " ".join(w)))
    found = licenses.find_licenses(documents(spark, rows), licenses.templates(spark))
    assert {(r.doc_id, r.template) for r in found.collect()} == license_brute(rows)


def test_recall_of_the_bands_alone(spark):
    """Windows that hold just over 0.8 of a template, and what shift the step may leave: how many collide in a band."""
    rnd = random.Random(14)
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        size = len(words) - 4
        for _ in range(12):
            own = list(words)
            while True:  # other words in, as long as 0.8 of the shingles stay
                k, old = rnd.randrange(len(own)), list(own)
                own[k] = f"other{rnd.random()}"
                if len({*spelt(" ".join(own))} & {*spelt(text)}) < 0.8 * len(set(spelt(text))):
                    break
            shift = rnd.randrange(-(max(1, size // 5) // 2), max(1, size // 5) // 2 + 1)
            padded = [f"before{k}" for k in range(size)] + old + [f"after{k}" for k in range(size)]
            rows.append((name, " ".join(padded[size + shift : size + shift + len(words)])))
    pairs = spark.createDataFrame(rows, "template string, w string").join(licenses.templates(spark), "template")
    hashes = lambda c: licenses._bound(licenses._words(F.col(c)), lambda w: licenses._shingles(w, licenses._hash))
    bands = lambda c: licenses._bound(hashes(c), licenses._bands)
    told = pairs.select(F.arrays_overlap(bands("w"), bands("text")).alias("met")).agg(F.avg(F.col("met").cast("int"))).first()[0]
    assert told >= 0.999


@pytest.mark.parametrize("most", [0, 20_000])
def test_a_window_goes_on_once_a_template(spark, monkeypatch, most):
    """A window and a template with many bands in common made a row a band, each with both texts' shingles."""
    monkeypatch.setattr(licenses, "MOST_SHINGLES", most)
    rows = [(1, licenses.TEMPLATES["MIT (text)"])]
    plan = licenses.find_licenses(documents(spark, rows), licenses.templates(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in plan or most == 0
    assert "first(around" not in plan and "first(spelt" not in plan


def test_license_edges(spark):
    assert licenses.find_licenses(empty(spark), licenses.templates(spark)).count() == 0
    short = spark.createDataFrame([("t", "too short"), ("u", None)], "template string, text string")
    assert licenses.find_licenses(documents(spark), short).count() == 0
    twice = [(1, "Released under the MIT License. " + "x " * 30 + "Released under the MIT License.")]
    assert licenses.find_licenses(documents(spark, twice), licenses.templates(spark)).count() == 2


# --- quality -----------------------------------------------------------------------------------------------


def test_largest(spark):
    rows = spark.createDataFrame([(i, 0.0, float(i % 7)) for i in range(300)], "doc_id bigint, log_weight double, key double").cache()
    for k in (0, 1, 77, 299, 300, 400):
        want = sorted(sorted(range(300), key=lambda i: (-(i % 7), i))[:k])
        assert sorted(r.doc_id for r in quality.largest(rows, k, bins=3, small=10).collect()) == want


def test_resampling_prefers_the_target(spark):
    rnd = random.Random(5)
    good = [(i, " ".join(rnd.choice(["tree", "river", "stone", "cloud", "light"]) for _ in range(40))) for i in range(150)]
    junk = [(i + 1000, " ".join(rnd.choice(["$$", "||", "%%", "tree"]) for _ in range(40))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(1000 + i, 0) for i in range(0, 50, 2)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality.resample(documents(spark, good + junk), labels).collect()}
    assert len(kept & set(range(150))) >= 145 and len(kept) == -(-200 * 76 // 101)


def test_gumbel_draws_follow_the_weights(spark):
    # Two kinds of documents, weights 3 : 1; the share among the first drawn follows the weights.
    weights = spark.range(20000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0).alias("log_weight"),
        (F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0) - F.log(-F.log((F.shiftrightunsigned(F.xxhash64("id"), 12).cast("double") + 0.5) / F.lit(float(1 << 52))))).alias("key"),
    )
    first = quality.largest(weights.cache(), 1000).where("doc_id % 2 = 0").count()
    assert abs(first / 1000 - 0.75) < 0.05


def test_weights_are_the_log_ratio_of_the_models(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three", "-", "x1"]) for _ in range(rnd.choice([0, 3, 40, 900])))) for i in range(60)]
    labelled = [i for i in range(60) if i % 3 == 0]
    labels = spark.createDataFrame([(i, 1) for i in labelled], "doc_id bigint, quality int")
    features = quality.Features()
    sums = np.zeros((2, quality.BUCKETS))
    for i, t in rows:
        for f in features(t):
            sums[1, f] += 1
            sums[0, f] += i in labelled
    raw = (sums[1] + 1) / (sums[1].sum() + quality.BUCKETS)
    target = (sums[0] + quality.BUCKETS * raw) / (sums[0].sum() + quality.BUCKETS)
    ratio = quality.model(documents(spark, rows), labels)
    assert np.allclose(ratio, np.log(target / raw))
    for temperature in (1.0, 5.0):
        weights = {r.doc_id: r.log_weight for r in quality.keys(documents(spark, rows), ratio, temperature=temperature).collect()}
        for i, t in rows:  # the sum over all features, however many
            assert np.isclose(weights[i], sum(np.log(target[f] / raw[f]) for f in features(t)) / temperature)
    found = quality.resample(documents(spark, rows), labels, fraction=0.3).collect()
    everyone = quality.noisy(quality.keys(documents(spark, rows), ratio)).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in sorted(everyone, key=lambda r: -r.key)[:18]}


@pytest.mark.parametrize("repeats", [4096, 7])
def test_repeated_rows_draw_each(spark, monkeypatch, repeats):
    monkeypatch.setattr(quality, "REPEATS", repeats)
    rows = [(1, "the same")] * 100 + [(None, None)] * 3 + [(2, "other")]
    found = quality.noisy(quality.keys(documents(spark, rows), np.zeros(quality.BUCKETS))).collect()
    assert sorted((r.doc_id or 0) for r in found) == [0] * 3 + [1] * 100 + [2]
    assert len({r.key for r in found}) == 104
    again = quality.noisy(quality.keys(documents(spark, rows).repartition(7), np.zeros(quality.BUCKETS))).collect()
    assert sorted(r.key for r in again) == sorted(r.key for r in found)


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.resample(documents(spark), labels).count() == len(ROWS)
    assert quality.resample(documents(spark), labels, fraction=0.0).count() == 0
    assert quality.resample(empty(spark), labels).count() == 0


# --- chat -------------------------------------------------------------------------------------------------


def test_fold(spark):
    log = [
        (1, 1, 0, "user", "message", "hi"),
        (1, 2, 1, "assistant", "message", ""),
        (1, 3, 1, None, "delta", "he"),
        (1, 4, 1, None, "delta", "llo"),
        (1, 5, 1, None, "regenerate", None),
        (1, 6, 1, None, "delta", "good "),
        (1, 7, 1, None, "delta", "day"),
        (1, 8, 2, "user", "message", "more"),
        (1, 9, 3, "assistant", "message", "some"),
        (1, 10, 2, None, "edit", "less"),
        (1, 11, 3, "assistant", "message", "none"),
        (2, 1, 0, "user", "message", None),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, turn bigint, role string, kind string, text string")
    rows = chat.fold_events(events.repartition(3)).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in rows] == [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good day"), (1, 2, "user", "less"), (1, 3, "assistant", "none"), (2, 0, "user", "")
    ]


def test_rendering_is_reversible(spark):
    rnd = random.Random(6)
    bits = ["\\", "[", "<", "/INST]", "[INST]", "</s>", "<s>", "\\l", "\\s", "\\b", "b", "é", "\n", "\U0001f600", " "]
    rows = [(c, t, rnd.choice(["user", "assistant", "sys<tem", None]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) if rnd.random() < 0.9 else None) for c in range(60) for t in range(rnd.randint(1, 5))]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    found = chat.chat_format(chat.as_events(table)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    said = {}
    for c, t, role, text in rows:
        said.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(found) == len(said)
    for r in found:
        turns = [x[1:] for x in sorted(said[r.conv_id])]
        assert [tuple(t) for t in r.turns] == turns
        learnt = [r.formatted[s.start : s.start + s.length].replace("\\l", "<").replace("\\s", "[").replace("\\b", "\\") for s in r.loss]
        assert learnt == [t for role, t in turns if role == "assistant"]
    assert chat.chat_format(chat.as_events(table.limit(0))).count() == 0


def test_one_very_long_conversation(spark):
    rows = spark.range(4000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> turn "), F.col("id")).alias("text")
    )
    rows = rows.unionByName(spark.createDataFrame([(2, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string")).repartition(5)
    found = {r.conv_id: r for r in chat.chat_format(chat.as_events(rows)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [t.text for t in found[1].turns] == [f"</s> turn {k}" for k in range(4000)] and len(found[1].loss) == 2000 and len(found[2].turns) == 1


# --- decontamination --------------------------------------------------------------------------------------


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i] + [0] * len(t)
        for j, d in enumerate(t, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_leaks_are_exactly_those_within_budget(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    items = [(i, word(rnd.choice([5, 9, 12, 30, 60, 120]))) for i in range(12)]
    items = [(i, t) for i, t in items if t.strip()]
    rows = []
    for n in range(80):
        t = word(rnd.randint(0, 150))
        if rnd.random() < 0.8:
            p = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, int(len(p) * 0.12) + 1)):
                k = rnd.randrange(len(p)) if p else 0
                how = rnd.random()
                if how < 0.4 and p:
                    p[k] = rnd.choice("abcdeé ")
                elif how < 0.7 and p:
                    del p[k]
                else:
                    p.insert(k, rnd.choice("abcdeé "))
            t += "".join(p).upper() + word(rnd.randint(0, 80))
        rows.append((n, t))
    index = decontaminate.Items(items, 5, 0.08)
    want = {}
    for d, t in rows:
        for k, (i, text) in enumerate(items):
            n = distance(decontaminate.normal(text), decontaminate.normal(t))
            if n <= index.budget[k]:
                want[d, i] = n
    bench = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id bigint, text string")
    found = decontaminate.find_leaks(documents(spark, rows), bench, q=5).collect()
    got = {}
    for r in found:
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
        text = decontaminate.normal(dict(rows)[r.doc_id])
        assert distance(decontaminate.normal(dict(items)[r.item_id]), text[r.start : r.end]) <= r.edits
    assert got == want
    clean = decontaminate.clean(documents(spark, rows), bench, q=5)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_many_items_and_many_rows():
    """Row number times item number beyond 32 bits; and only few entries at a time."""
    items = [(k, f"{k:010d}") for k in range(300_000)]
    index = decontaminate.Items(items, 10, 0.08)
    texts = ["x y"] * 9_000
    texts[10], texts[8_900] = "so 0000271828 it is", "so 0000271828 it is 0000000007"
    assert sorted(index.matches(texts)) == [(10, 271828, 3, 13, 0), (8900, 7, 20, 30, 0), (8900, 271828, 3, 13, 0)]


def test_few_entries_at_a_time(monkeypatch):
    rnd = random.Random(11)
    items = [(k, "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40)))) for k in range(30)]
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 200))) for _ in range(40)]
    index = decontaminate.Items(items, 4, 0.08)
    whole = index.matches(texts)
    for entries in (1, 50, 3000):
        monkeypatch.setattr(decontaminate, "ENTRIES", entries)
        assert index.matches(texts) == whole


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 60)
    items = [(k, f"the {k} passage that is asked in the test set number {k * 7}") for k in range(5)]
    rows = [(k, f"so {t} it is") for k, t in items] + ROWS
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents(spark, rows), bench).collect()} >= {(k, k) for k in range(5)}
    kept = decontaminate.clean(documents(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", *EXTRA] and kept.count() == len(ROWS)


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.clean(documents(spark), none).count() == len(ROWS)
    assert decontaminate.find_leaks(documents(spark), none).count() == 0
    some = spark.createDataFrame([(1, "lorem ipsum dolor sit amet")], "item_id bigint, text string")
    assert decontaminate.clean(empty(spark), some).count() == 0
    assert {r.doc_id for r in decontaminate.find_leaks(documents(spark), some).collect()} == {6, 7}


# --- toxicity ---------------------------------------------------------------------------------------------


def toxic_corpus(n=600):
    rnd = random.Random(8)
    plain = "the of and river stone walk green house song winter bread paper letter road".split()
    groups = "women men gays immigrants muslims christians".split()
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randint(3, 60))]
        toxic = int(rnd.random() < 0.3)
        # Identity terms come far more often with toxic rows.
        if rnd.random() < (0.8 if toxic else 0.1):
            w.insert(rnd.randrange(len(w)), rnd.choice(groups))
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vermin", "scumbag", "worthless"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id bigint, toxic int"))
    found = toxicity.score(documents(spark, rows), model).collect()
    truth = dict(labels)
    held = [r for r in found if r.held_out]
    assert 0.15 < len(held) / len(found) < 0.35
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = toxicity.clean(documents(spark, rows), model)
    assert kept.columns == ["doc_id", "text", *EXTRA] and kept.count() == sum(r.predicted == 0 for r in found)


def test_counterfactual_penalty_evens_out_groups(spark):
    rows, labels = toxic_corpus()
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    spread = {}
    for fairness in (0.0, 5.0):
        model = toxicity.fit(documents(spark, rows), labels, fairness=fairness, l1=0.5)
        base = model.logit("the song of people")
        spread[fairness] = max(abs(model.logit(f"the song of {g}") - base) for g in "women gays immigrants muslims".split())
        assert model.score("the worthless song") > 0.3
    assert spread[5.0] < 0.4 * spread[0.0]
    assert toxicity.fit(documents(spark, rows), labels).score("the song of gays and muslims in winter") < 0.3


def test_swaps_change_the_features_that_differ():
    for text in ("", "the old black song of people", "mensch und frau", "nothing of the kind, a disgrace", "x"):
        words = set(toxicity.WORD.findall(text))
        want = []
        for own, term, terms in toxicity.mentions(words):
            others = [t for t in terms if t != term]
            want += [(tuple(sorted(toxicity.features(own - {term} | {o}) - toxicity.features(own))), tuple(sorted(toxicity.features(own) - toxicity.features(own - {term} | {o})))) for o in others]
        found = [(tuple(more), tuple(less)) for more, less in toxicity.counterfactuals(words, swaps=20)]
        assert set(found) == set(want) and bool(found) == bool(words)


def test_gradient_of_the_loss():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 6, 40)
    at = np.concatenate([[0], np.cumsum(sizes)])
    values = rng.integers(0, 12, at[-1])
    swaps = [(sorted(set(rng.integers(0, 12, 3).tolist())), sorted(set(rng.integers(0, 12, 2).tolist()))) for _ in range(9)]
    swaps += [*swaps[:4], swaps[0], ([], [])]
    loss = toxicity.Loss(values, at, rng.integers(0, 2, 40), swaps, 0.7)
    w, bias = rng.normal(size=12), 0.3
    _, grad, missed = loss(w, bias)
    step = 1e-6
    for k in range(12):
        up = w.copy()
        up[k] += step
        assert np.isclose((loss(up, bias)[0] - loss(w, bias)[0]) / step, grad[k], atol=1e-3)
    assert np.isclose((loss(w, bias + step)[0] - loss(w, bias)[0]) / step, missed, atol=1e-3)


def test_penalty_acts_without_any_mention(spark):
    """No labelled text names a group, but words of toxic ones share beginnings with terms that do."""
    rnd = random.Random(12)
    plain = "the of and river stone walk green house song winter bread paper letter road".split()
    rows = []
    for i in range(500):
        w = [rnd.choice(plain) for _ in range(rnd.randint(3, 40))]
        if i % 3 == 0:
            w.append(rnd.choice(["musly", "disgrace", "transgression", "jewfoo"]))
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    assert not any(set(t.split()) & {x for terms in toxicity.IDENTITY_TERMS for x in terms} for _, t in rows)
    told = {}
    for fairness in (0.0, 5.0):
        model = toxicity.fit(documents(spark, rows), labels, l1=0.5, fairness=fairness)
        told[fairness] = toxicity.swap_report(documents(spark, rows), model).first()
        held = [r for r in toxicity.score(documents(spark, rows), model).collect() if r.held_out]
        assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert told[0.0].swaps == told[5.0].swaps > 500 and told[0.0].moved > 0
    assert told[5.0].mean_change < 0.5 * told[0.0].mean_change
    assert toxicity.mentions(set()) == []


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark), none)
    assert [r.score for r in toxicity.score(documents(spark), model).collect()] == [0.0] * len(ROWS)
    one = toxicity.fit(documents(spark), spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int"))
    assert all(0 < r.score < 1 for r in toxicity.score(documents(spark), one).collect())
    assert toxicity.score(empty(spark), model).count() == 0 == toxicity.clean(empty(spark), model).count()
