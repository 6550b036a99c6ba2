import gzip

from pyspark.sql import functions as F

from antipode.functions import sampling, text
from antipode.operators import cooccurrence, thesaurus, vocabulary
from antipode.sources import corpus


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_case_and_space(spark):
    said = "ÉTÉ A\tb\x0bc\rd\u00a0e  "
    assert one(spark, lambda c: text.tokens(text.lower_ascii(c)), said) == ["ÉtÉ", "a", "b", "c", "d\u00a0e"]


def test_words(spark):
    assert [one(spark, text.strip_pos, w) for w in ("a_NOUN", "_x", "plain", "a_b_c")] == ["a", "_x", "plain", "a"]
    assert [one(spark, text.integer_prefix, w) for w in ("12", "12x", "x", "-3", "")] == [12, 12, 0, -3, 0]
    assert one(spark, text.normalise_digits, "a1b23") == "a7b77"
    assert [text.distance_weight(d, 5, 1) for d in (1, 2)] == [1.0, 0.5]
    assert [round(text.distance_weight(d, 5, 2), 9) for d in range(1, 6)] == [1.0, 0.8, 0.6, 0.4, 0.2]
    assert text.distance_weight(3, 5, 0) == text.distance_weight(3, 5, 9) == 1.0


def test_gzip_corpus(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(b"Hello a\rb c\nsecond\n")
    (tmp_path / "other.txt").write_text("not read\n")
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "b.gz", "wb") as f:
        f.write(b"not read\n")
    lines = corpus.read_corpus(spark, str(tmp_path))
    assert sorted(r.line for r in lines.collect()) == ["Hello a\rb c", "second"]
    assert [r.word for r in corpus.tokenise(lines.where("line <> 'second'"), "line").orderBy("pos").collect()] == ["hello", "a", "b", "c"]


def test_ngram_records(spark):
    lines = spark.createDataFrame([("A_DET b c d e 2000 10 3",), ("too few fields",), ("a b c d e 2000 x 1 ",)], "line string")
    counts = {r["word"]: r["count"] for r in vocabulary.ngram_word_counts(corpus.ngram_records(lines)).collect()}
    assert counts == dict.fromkeys("abcde", 2.0)


def counts(spark):
    return spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 4.0), ("d", 3.0), ("e", 3.0), ("f", 1.0)], "word string, count double")


def test_whole_ties(spark):
    for n, kept in ((1, 3), (2, 3), (3, 5), (5, 6), (9, 6)):
        assert vocabulary.vocabulary(counts(spark), n).count() == kept
    assert [r.word for r in vocabulary.vocabulary(counts(spark), 2, ties="strict").orderBy("id").collect()] == ["a", "b"]
    assert [r.word for r in vocabulary.vocabulary(counts(spark), 5, minimum=4).orderBy("id").collect()] == ["a", "b", "c"]
    assert vocabulary.vocabulary(counts(spark).limit(0), 5).count() == 0


def test_dictionary_words(spark):
    words = spark.createDataFrame([("b",), ("zzz",)], "word string")
    rows = vocabulary.vocabulary(counts(spark), 1, dictionary=words).orderBy("id").collect()
    assert [(r["word"], r["count"], r["is_dict"]) for r in rows] == [("a", 5.0, False), ("c", 4.0, False), ("b", 4.0, True), ("zzz", 0.0, True)]


def encoded(spark, words):
    ids = {"a": 0, "b": 1}
    return spark.createDataFrame([(0, p, ids.get(w)) for p, w in enumerate(words)], "s int, pos bigint, id bigint")


def test_windows(spark):
    rows = cooccurrence.cooccurrences(encoded(spark, "axba"), 2, 0, "s", symmetric=False).collect()
    assert sorted((r["w1"], r["w2"], r["count"]) for r in rows) == [(0, 1, 1.0), (1, 0, 1.0)]
    rows = cooccurrence.cooccurrences(encoded(spark, "aa"), 1, 0, "s").collect()
    assert [(r["w1"], r["w2"], r["count"]) for r in rows] == [(0, 0, 2.0)]
    rows = cooccurrence.sentence_cooccurrences(encoded(spark, "axba"), "s").collect()
    assert sorted((r["w1"], r["w2"], r["count"]) for r in rows) == [(0, 0, 2.0), (0, 1, 2.0), (1, 0, 2.0)]


def test_thesaurus(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id bigint, word string")
    lines = spark.createDataFrame([("A b a c zzz",), ("zzz a b",), ("b a",), ("",)], "line string")
    assert sorted((r.a, r.b) for r in thesaurus.thesaurus(lines, vocab, "syn").collect()) == [(0, 1), (0, 2)]


def test_rounding(spark):
    rows = spark.createDataFrame([(0.9e-5,), (1e-5,), (0.5,), (1.0,), (2.5,)], "x double")
    for draw, told in ((0.0, [0.0, 1.0, 1.0, 1.0, 2.5]), (0.7, [0.0, 0.0, 0.0, 1.0, 2.5])):
        assert [r[0] for r in rows.select(sampling.rounded(F.col("x"), F.lit(draw))).collect()] == told
    draws = [r[0] for r in spark.range(20000).select(sampling.uniform(1, "t", F.col("id"))).collect()]
    assert abs(sum(d < 0.3 for d in draws) / len(draws) - 0.3) < 0.02


def test_both_ways_to_pairs_agree(spark, monkeypatch):
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id bigint, word string")
    lines = spark.createDataFrame([(0, "A x b a c c"), (1, ""), (2, "b"), (3, "c b a a x x x b")], "s int, line string")
    found = []
    for most in (10, 1):
        monkeypatch.setattr(cooccurrence, "BROADCAST_WORDS", most)
        found.append(sorted(map(tuple, cooccurrence.line_cooccurrences(lines, vocab, 3, 1, "s").collect())))
    assert found[0] == found[1] and found[0]


def test_words_of_texts_are_the_tokens_of_their_lines(spark):
    texts = ["", None, " a\n\nB\tc\x0bd \x0ce\r", "\u00c9T\u00c9 x\u00a0y\n", "\n", "one"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    lines = corpus.tokenise(corpus.sentences(rows), "doc_id", "line_no")
    assert sorted(r.word for r in corpus.words(rows).collect()) == sorted(r.word for r in lines.collect()) != []
