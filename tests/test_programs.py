import gzip
import random

import pytest

from antipode import __main__ as programs
from antipode.sources import storage


def test_from_text_to_answers(spark, tmp_path):
    rnd = random.Random(0)
    words = [f"w{i}" for i in range(30)]
    (tmp_path / "text").mkdir()
    for k in range(2):
        with gzip.open(tmp_path / "text" / f"{k}.gz", "wt") as f:
            f.writelines(" ".join(rnd.choice(words) for _ in range(12)) + "\n" for _ in range(60))
    (tmp_path / "syn.txt").write_text("w0 w1\nw2 w3\nw4 w5 w0\n")
    (tmp_path / "ant.txt").write_text("w0 w9\nw2 w8\nw4 w7\n")
    (tmp_path / "questions.txt").write_text("w0: w1 w9 w11 w12 w13 :: w9\nw2: w3 w8 w14 w15 w16 :: w8\nw4: w5 w7 w17 zz w18 :: w7\n")
    at = {k: str(tmp_path / k) for k in ("text", "vocab", "cooc", "model")}
    native = {k: str(tmp_path / f"{k}.bin") for k in ("vocab", "cooc", "model")}
    vocab = programs.count_words(spark, at["text"], 40, at["vocab"], native=native["vocab"])
    assert vocab.count() == 30
    cooc = programs.count_pairs(spark, at["text"], at["vocab"], at["cooc"], 5, 2, native=native["cooc"])
    assert cooc.count() > 100
    read = storage.read_vocabulary_file(spark, native["vocab"])
    assert sorted(map(tuple, read.collect())) == sorted((r["id"], r["word"], r["count"]) for r in vocab.collect())
    assert storage.read_cooccurrence_files(spark, native["cooc"]).exceptAll(cooc.select("w1", "w2", "count")).count() == 0
    files = {"synonyms": str(tmp_path / "syn.txt"), "antonyms": str(tmp_path / "ant.txt")}
    first = programs.train_model(spark, at["vocab"], at["cooc"], at["model"], 3, dim=8, tasks=2, native=native["model"], **files)
    assert storage.read_model_file(spark, native["model"])[1] == 3
    more = programs.train_model(spark, at["vocab"], at["cooc"], at["model"], 2, tasks=2, **files)
    assert more[-1] < first[0]
    scores, metrics = programs.score(spark, at["model"], str(tmp_path / "questions.txt"), antonyms=files["antonyms"])
    assert sorted((r.target, r.candidate) for r in scores.where("in_dict").collect()) == [("w0", "w9"), ("w2", "w8"), ("w4", "w7")]
    row = metrics.first()
    assert (row.total, row.answered, row.correct) == (3, 2, 2)


def test_score_of_text_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 0\nb -1 0\nc 1 1\nA 5 5\n")
    (tmp_path / "q.txt").write_text("a: c b c c c :: b\n")
    _, metrics = programs.score(spark, str(tmp_path / "v.txt"), str(tmp_path / "q.txt"), vectors="plain")
    assert metrics.first().correct == 1


def test_phases_are_timed(capsys):
    with programs.timed("phase"):
        pass
    assert " phase: 0.0 s, driver " in capsys.readouterr().err


def test_absent_modules_are_left_out_and_broken_ones_are_told(tmp_path, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "broken_module.py").write_text("import no_such_dependency")
    assert entry._optional("no_such_module") is None and entry._optional("no_such_package.part") is None
    with pytest.warns(UserWarning, match="no_such_dependency"):
        assert entry._optional("broken_module") is None
