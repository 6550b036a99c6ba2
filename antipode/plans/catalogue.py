"""Every registered query of the engine and the SQL that states the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sampling, vectors
from ..functions import text as text_functions
from ..operators import cooccurrence, evaluation, heavy_hitters, similarity, thesaurus, training, updates, vocabulary
from ..sources import corpus, storage
from ..sources.parallel import spread
from ..streaming import word_counts as streaming
from . import oracle as o

QUERIES = {}
ORACLES = {}
KEY = ("doc_id", "line_no")
#: Parameters of the registered queries.
N, WINDOW, THRESHOLD = 1000, 5, 1e-3


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- shared sub-plans -------------------------------------------------------------------------------


def _sentences(spark, sf_dir):
    return corpus.sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _tokens(spark, sf_dir):
    return corpus.tokenise(_sentences(spark, sf_dir), *KEY)


def _words(spark, sf_dir):
    return corpus.words(spread(table(spark, sf_dir, "documents").select("text")))


def _vocab(spark, sf_dir):
    # Read many times by what follows, and small: written once.
    return storage.written(vocabulary.vocabulary(vocabulary.word_counts(_words(spark, sf_dir)), N), "vocab")


def _encoded(spark, sf_dir, vocab):
    return vocabulary.encode(_tokens(spark, sf_dir), vocab, *KEY)


def _cooc(spark, sf_dir, vocab, weight=1):
    return cooccurrence.line_cooccurrences(_sentences(spark, sf_dir), vocab, WINDOW, weight, *KEY)


def _training_inputs(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    cooc = storage.written(_cooc(spark, sf_dir, vocab), "cooc")
    stats = storage.written(updates.word_stats(vocab, cooc, THRESHOLD), "stats")
    return vocab, cooc, stats


def _dictionary(vocab, kind):
    """Lines of a made-up dictionary over the whole vocabulary: the head word, a related word, a word that isn't known, the
    head again. Some pairs are synonyms and antonyms at once."""
    ids = vocab.select("id", "word")
    head = F.col("id") % 4 == 0 if kind == "syn" else (F.col("id") % 8 == 0) | (F.col("id") % 4 == 2)
    heads = ids.where(head).select("id", "word", (F.col("id") + 1).alias("other"))
    related = ids.select(F.col("id").alias("other"), F.col("word").alias("related"))
    return heads.join(related, "other").select(F.concat_ws(" ", "word", "related", F.lit("zzz-unknown"), "word").alias("line"))


def _thesaurus(vocab):
    syn = thesaurus.thesaurus(_dictionary(vocab, "syn"), vocab, "syn")
    return syn.unionByName(thesaurus.thesaurus(_dictionary(vocab, "ant"), vocab, "ant"))


def _model(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("w"), F.col("vec_id")).alias("word"),
        ((F.col("label") - 2) / F.lit(10.0)).alias("bias"),
        F.lit(0.0).alias("grad"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def _question_lines(spark):
    ids = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.concat(F.lit("W"), ((F.col("qid") * 7 + j * 13) % 600).cast("string")))
    answer = F.concat(F.lit("W"), ((F.col("qid") * 7 + (F.col("qid") % 5 + 1) * 13) % 600).cast("string"))
    rows = spark.range(100).select(F.col("id").alias("qid"))
    return rows.select("qid", F.concat_ws(" ", F.concat(F.lit("W"), F.col("qid"), F.lit(":")), F.array_join(ids, " "), F.lit("::"), answer).alias("line"))


def _questions(spark):
    return corpus.questions(_question_lines(spark), "qid")


def _antonym_ids(spark):
    return spark.range(100).select(F.least(F.col("id"), (F.col("id") * 7 + 13) % 600).alias("a"), F.greatest(F.col("id"), (F.col("id") * 7 + 13) % 600).alias("b"))


def _flat(rows, *key):
    """One row a component, so that results hold no arrays."""
    return rows.select(*key, F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("bigint"))


# --- tokens and vocabularies --------------------------------------------------------------------------


@query(o.sql(o.TOKENS, "SELECT doc_id, line_no, pos, word FROM tokens"))
def tokenize(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", "line_no", "pos", "word")


@query(o.sql(o.SENTENCES, f"SELECT doc_id, line_no, len({o.split('line')})::BIGINT AS n_tokens FROM sentences"))
def sentence_token_counts(spark, sf_dir):
    n = F.size(text_functions.tokens(text_functions.lower_ascii(F.col("line"))))
    return _sentences(spark, sf_dir).select("doc_id", "line_no", n.cast("bigint").alias("n_tokens"))


@query(o.sql(o.COUNTS, 'SELECT word, "count" FROM counts'))
def word_counts(spark, sf_dir):
    return vocabulary.word_counts(_words(spark, sf_dir))


@query(o.sql(o.VOCAB, 'SELECT id, word, "count", false AS is_dict FROM vocab'))
def vocab_topn_ties(spark, sf_dir):
    return vocabulary.vocabulary(vocabulary.word_counts(_words(spark, sf_dir)), N)


@query(o.sql(o.COUNTS, f'SELECT row_number() OVER (ORDER BY "count" DESC, word) - 1 AS id, word, "count", false AS is_dict FROM counts QUALIFY id < {N}'))
def vocab_topn_strict(spark, sf_dir):
    return vocabulary.vocabulary(vocabulary.word_counts(_words(spark, sf_dir)), N, ties="strict")


@query(
    o.sql(
        o.COUNTS,
        f"""ranked AS (SELECT *, rank() OVER (ORDER BY "count" DESC) AS r FROM counts WHERE "count" >= 50)""",
        f'SELECT row_number() OVER (ORDER BY "count" DESC, word) - 1 AS id, word, "count", false AS is_dict FROM ranked WHERE r <= {N + 1}',
    )
)
def vocab_min_count(spark, sf_dir):
    return vocabulary.vocabulary(vocabulary.word_counts(_words(spark, sf_dir)), N, minimum=50)


@query(
    o.sql(
        o.COUNTS,
        f"dict AS (SELECT DISTINCT unnest({o.split('text')}) AS word FROM benchmark WHERE text IS NOT NULL)",
        """ranked AS (SELECT word, "count", rank() OVER (ORDER BY "count" DESC) AS r FROM counts ANTI JOIN dict USING (word))""",
        f"""kept AS (SELECT word, "count", false AS is_dict FROM ranked WHERE r <= {N + 1}
          UNION ALL SELECT d.word, coalesce(c."count", 0)::DOUBLE, true FROM dict d LEFT JOIN counts c USING (word))""",
        """SELECT row_number() OVER (ORDER BY is_dict, CASE WHEN NOT is_dict THEN "count" END DESC, word) - 1 AS id, word, "count", is_dict FROM kept""",
    )
)
def vocab_with_dict(spark, sf_dir):
    words = corpus.dictionary_words(table(spark, sf_dir, "benchmark").select(F.col("text").alias("line")))
    return vocabulary.vocabulary(vocabulary.word_counts(_words(spark, sf_dir)), N, dictionary=words)


def _record_lines(spark, sf_dir):
    """An n-gram record of every five-word window of every line; some tokens with part-of-speech suffixes. Each window
    makes a record of seven fields too, which is malformed and counts nothing."""
    words = text_functions.tokens(F.col("line"))
    rows = _sentences(spark, sf_dir).select("doc_id", words.alias("w")).where(F.size("w") >= 5)
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.slice(F.col("w"), i + 1, F.lit(5)))
    rows = rows.select("doc_id", F.explode(windows).alias("w"))
    tag = F.when(F.col("doc_id") % 2 == 0, F.concat(F.get("w", F.lit(0)), F.lit("_NOUN"))).otherwise(F.get("w", F.lit(0)))
    head = F.concat_ws(" ", tag, F.array_join(F.slice("w", 2, 4), " "), (F.col("doc_id") % 7).cast("string"))
    return rows.select(F.explode(F.array(F.concat(head, F.lit(" 2000\t3")), F.concat(head, F.lit(" 2000")))).alias("line"))


@query(
    o.sql(
        o.SENTENCES,
        f"cut AS (SELECT doc_id, {o.split('line')} AS w FROM sentences)",
        "windows AS (SELECT doc_id, list_slice(w, i, i + 4) AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5))",
        "records AS (SELECT unnest(list_concat([CASE WHEN doc_id % 2 = 0 THEN CASE WHEN strpos(w[1] || '_noun', '_') > 1 THEN split_part(w[1] || '_noun', '_', 1) ELSE w[1] || '_noun' END WHEN strpos(w[1], '_') > 1 THEN split_part(w[1], '_', 1) ELSE w[1] END], "
        "list_transform(w[2:5], lambda x: CASE WHEN strpos(x, '_') > 1 THEN split_part(x, '_', 1) ELSE x END))) AS word, 2000 AS n FROM windows)",
        'SELECT word, sum(n)::DOUBLE / 5.0::DOUBLE AS "count" FROM records GROUP BY word',
    )
)
def ngram_word_counts(spark, sf_dir):
    return vocabulary.ngram_word_counts(corpus.ngram_records(_record_lines(spark, sf_dir)))


@query(o.sql(o.TOKENS, "SELECT regexp_replace(word, '[0-9]', '7', 'g') AS word, count(*)::DOUBLE AS \"count\" FROM tokens GROUP BY 1"))
def digit_normalised_counts(spark, sf_dir):
    return vocabulary.word_counts(corpus.tokenise(_sentences(spark, sf_dir), *KEY, digits=True))


@query(o.sql(o.VOCAB, "SELECT doc_id, line_no, pos, coalesce(id, -1) AS id FROM tokens LEFT JOIN vocab USING (word)"))
def encode_tokens(spark, sf_dir):
    """-1 for words out of the vocabulary."""
    return _encoded(spark, sf_dir, _vocab(spark, sf_dir)).fillna({"id": -1})


@query()
def spacesaving_topk(spark, sf_dir):
    """Approximate; ``spacesaving_bounds`` holds the bounds against exact counts."""
    found = heavy_hitters.heavy_hitters(_words(spark, sf_dir), 10 * N)
    return found.orderBy(F.desc("count"), "word").limit(100)


@query(o.sql(o.COUNTS, """top AS (SELECT word, "count" AS true_count FROM counts ORDER BY "count" DESC, word LIMIT 100)""", "SELECT word, true_count, true AS found, true AS within_bounds FROM top"))
def spacesaving_bounds(spark, sf_dir):
    """The 100 most frequent words by exact counts: are they in the summary, and within its bounds?"""
    tokens = _words(spark, sf_dir)
    exact = vocabulary.word_counts(tokens).orderBy(F.desc("count"), "word").limit(100).select("word", F.col("count").alias("true_count"))
    rows = exact.join(heavy_hitters.heavy_hitters(tokens, 10 * N), "word", "left")
    within = F.col("true_count").between(F.col("count") - F.col("epsilon"), F.col("count"))
    return rows.select("word", "true_count", F.col("count").isNotNull().alias("found"), F.coalesce(within, F.lit(False)).alias("within_bounds"))


@query(o.sql(o.COUNTS, """top AS (SELECT word, "count" AS true_count FROM counts ORDER BY "count" DESC, word LIMIT 100)""", "SELECT word, true_count, true AS found, true AS within_bounds FROM top"))
def stream_spacesaving_bounds(spark, sf_dir):
    """The same of a stream's summary, whose state is bounded."""
    exact = vocabulary.word_counts(_words(spark, sf_dir)).orderBy(F.desc("count"), "word").limit(100).select("word", F.col("count").alias("true_count"))
    rows = exact.join(streaming.stream_heavy_hitters(spark, f"{sf_dir.rstrip('/')}/documents.parquet", 10 * N), "word", "left")
    within = F.col("true_count").between(F.col("count") - F.col("epsilon"), F.col("count"))
    return rows.select("word", "true_count", F.col("count").isNotNull().alias("found"), F.coalesce(within, F.lit(False)).alias("within_bounds"))


@query(o.sql(o.COUNTS, 'SELECT word, "count" FROM counts'))
def stream_word_counts(spark, sf_dir):
    return streaming.stream_word_counts(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


# --- co-occurrence ------------------------------------------------------------------------------------


@query(o.sql(o.VOCAB, o.pairs(WINDOW, 0), 'SELECT w1, w2, "count" FROM cooc'))
def cooc_unweighted(spark, sf_dir):
    return _cooc(spark, sf_dir, _vocab(spark, sf_dir), 0)


@query(o.sql(o.VOCAB, o.pairs(WINDOW, 1), 'SELECT w1, w2, "count" FROM cooc'))
def cooc_harmonic(spark, sf_dir):
    return _cooc(spark, sf_dir, _vocab(spark, sf_dir), 1)


@query(o.sql(o.VOCAB, o.pairs(WINDOW, 2), 'SELECT w1, w2, "count" FROM cooc'))
def cooc_linear(spark, sf_dir):
    return _cooc(spark, sf_dir, _vocab(spark, sf_dir), 2)


@query(o.sql(o.VOCAB, o.pairs(WINDOW, 1, symmetric=False), 'SELECT w1, w2, "count" FROM cooc'))
def cooc_directed(spark, sf_dir):
    """From encoded tokens, as beyond a broadcast vocabulary."""
    return cooccurrence.cooccurrences(_encoded(spark, sf_dir, _vocab(spark, sf_dir)), WINDOW, 1, *KEY, symmetric=False)


@query(
    o.sql(
        o.VOCAB,
        "known AS (SELECT doc_id, line_no, pos, id FROM tokens JOIN vocab USING (word))",
        "one AS (SELECT a.id AS w1, b.id AS w2 FROM known a JOIN known b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.pos < b.pos)",
        'SELECT w1, w2, count(*)::DOUBLE AS "count" FROM (SELECT w1, w2 FROM one UNION ALL SELECT w2, w1 FROM one) GROUP BY ALL',
    )
)
def cooc_sentence(spark, sf_dir):
    """Pairs of whole sentences, however long."""
    return cooccurrence.sentence_cooccurrences(_encoded(spark, sf_dir, _vocab(spark, sf_dir)), *KEY)


def top_cooccurrences(spark, sf_dir):
    return _cooc(spark, sf_dir, _vocab(spark, sf_dir)).orderBy(F.desc("count"), "w1", "w2").limit(100)


# --- sampling statistics and the training table ---------------------------------------------------------


@query(o.sql(o.VOCAB, 'SELECT id, "count", round(keep_p, 9) AS keep_p FROM (SELECT id, "count", least(CASE WHEN s > 0 THEN (sqrt(s) + 1) / s ELSE 1 END, 1.0::DOUBLE) AS keep_p FROM (SELECT *, "count" / (1e-3::DOUBLE * sum("count") OVER ()) AS s FROM vocab))'))
def keep_probability(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    total = vocab.agg(F.sum("count").alias("total"))
    rows = vocab.crossJoin(F.broadcast(total))
    return rows.select("id", "count", F.round(sampling.keep_probability(F.col("count"), F.col("total"), THRESHOLD), 9).alias("keep_p"))


@query(o.sql(o.STATS, "SELECT id, round(neg_w, 6) AS neg_w, rank, round(neg_total, 3) AS neg_total FROM weighted"))
def negative_weights(spark, sf_dir):
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    total = stats.agg(F.round(F.sum("neg_w"), 3).alias("neg_total"))
    return stats.crossJoin(F.broadcast(total)).select("id", F.round("neg_w", 6).alias("neg_w"), "rank", "neg_total")


@query(o.sql(o.STATS, "SELECT id, round(sub_count, 6) AS sub_count FROM stats"))
def subsampled_counts(spark, sf_dir):
    return _training_inputs(spark, sf_dir)[2].select("id", F.round("sub_count", 6).alias("sub_count"))


@query(o.sql(o.STATS, o.EXPECTED, "SELECT w1, w2, round(pos_e, 6) AS pos_e, round(neg_e, 6) AS neg_e FROM expected"))
def observed_expectations(spark, sf_dir):
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    rows = updates.observed_expectations(cooc, stats)
    return rows.select("w1", "w2", F.round("pos_e", 6).alias("pos_e"), F.round("neg_e", 6).alias("neg_e"))


@query(o.sql(o.STATS, o.EXPECTED, o.THESAURUS, o.OBSERVED, "SELECT w1, w2, round(pos, 6) AS pos, round(neg, 6) AS neg FROM observed"))
def observed_updates(spark, sf_dir):
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    rows = updates.observed_updates(cooc, stats, _thesaurus(vocab))
    return rows.select("w1", "w2", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


@query(o.sql(o.STATS, o.THESAURUS, o.IMPLICIT, "SELECT w1, w2, pos, round(neg, 6) AS neg FROM implicit"))
def implicit_negatives(spark, sf_dir):
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    rows = updates.implicit_negatives(cooc, stats, _thesaurus(vocab))
    return rows.select("w1", "w2", "pos", F.round("neg", 6).alias("neg"))


@query(o.sql(o.VOCAB, o.THESAURUS, "SELECT a, b, kind FROM pairs"))
def thesaurus_pairs(spark, sf_dir):
    return _thesaurus(_vocab(spark, sf_dir))


@query(o.sql(o.VOCAB, o.THESAURUS, o.SAID, "SELECT w1, w2, pos, round(neg, 6) AS neg, origin FROM said"))
def thesaurus_updates(spark, sf_dir):
    rows = updates.thesaurus_updates(_thesaurus(_vocab(spark, sf_dir)))
    return rows.select("w1", "w2", "pos", F.round("neg", 6).alias("neg"), "origin")


@query(o.sql(o.STATS, o.EXPECTED, o.THESAURUS, o.OBSERVED, o.IMPLICIT, o.SAID, o.UPDATES, "SELECT w1, w2, round(pos, 6) AS pos, round(neg, 6) AS neg, origin FROM updates"))
def update_table(spark, sf_dir):
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    rows = updates.update_table(cooc, stats, _thesaurus(vocab))
    return rows.select("w1", "w2", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"), "origin")


@query(
    o.sql(
        o.STATS, o.EXPECTED, o.THESAURUS, o.OBSERVED, o.IMPLICIT, o.SAID, o.UPDATES,
        """SELECT (SELECT round(sum("count"), 3) FROM cooc) AS count_total, (SELECT count(*) FROM cooc) AS unique_pairs,
          (SELECT round(sum(sub_count), 3) FROM stats) AS sampled_total, count(*) AS updates, round(sum(pos), 3) AS pos_total, round(sum(neg), 3) AS neg_total,
          (SELECT 2 * count(*) FROM pairs WHERE kind = 'syn')::BIGINT AS synonym_matches, (SELECT 2 * count(*) FROM pairs WHERE kind = 'ant')::BIGINT AS antonym_matches
        FROM updates WHERE origin IN ('observed', 'implicit')""",
    )
)
def setup_statistics(spark, sf_dir):
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    words = _thesaurus(vocab)
    rows = updates.setup_statistics(cooc, stats, words, updates.update_table(cooc, stats, words))
    rounded = ("count_total", "sampled_total", "pos_total", "neg_total")
    return rows.select(*(F.round(c, 3).alias(c) if c in rounded else c for c in rows.columns))


# --- model queries ----------------------------------------------------------------------------------------


@query(o.sql(o.MODEL, f"SELECT x.id AS a, y.id AS b, round({o.similarity('x', 'y')}, 6) AS similarity FROM model x JOIN model y ON y.id = x.id + 1"))
def pair_similarity(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = similarity.pair_similarity(model.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), model)
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(o.sql(o.MODEL, "SELECT x.id AS a, y.id AS b, round(list_dot_product(x.vec, y.vec) / sqrt(list_dot_product(x.vec, x.vec)) / sqrt(list_dot_product(y.vec, y.vec)), 6) AS cosine FROM model x JOIN model y ON y.id = x.id + 1"))
def pair_cosine(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = similarity.pair_similarity(model.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), model)
    return rows.select("a", "b", F.round("cosine", 6).alias("cosine"))


def _asked(model):
    """Every row whose id is divisible by 20, so that the work grows with the table."""
    return model.where("id % 20 = 0").select(F.col("word").alias("query"))


@query(o.sql(o.MODEL, o.similar("DESC")))
def similar_words(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = similarity.similar_words(_asked(model), model)
    return rows.select("query", "rank", "word", F.round("similarity", 6).alias("similarity"))


@query(o.sql(o.MODEL, o.similar("ASC")))
def dissimilar_words(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = similarity.similar_words(_asked(model), model, reverse=True)
    return rows.select("query", "rank", "word", F.round("similarity", 6).alias("similarity"))


@query("SELECT 'no such word' AS query, unnest(range(1, 11))::BIGINT AS rank, 'unknown' AS word, 0.0::DOUBLE AS similarity")
def similar_unknown(spark, sf_dir):
    return similarity.similar_words(spark.createDataFrame([("no such word",)], "query string"), _model(spark, sf_dir))


def _model_of_vocab(spark, sf_dir):
    """The made-up vectors under the vocabulary's words."""
    return _model(spark, sf_dir).drop("word").join(_vocab(spark, sf_dir).select("id", "word"), "id")


@query(
    o.sql(
        o.VOCAB,
        o.MODEL,
        "named AS (SELECT v.word, m.vec FROM model m JOIN vocab v USING (id))",
        "talk AS (SELECT conv_id, turn, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL))",
        f"spoken AS (SELECT conv_id, turn, line_no, unnest({o.split('line')}) AS word FROM talk)",
        "parts AS (SELECT conv_id, turn, line_no, unnest(range(64)) AS i, unnest(vec) AS x FROM spoken JOIN named USING (word))",
        "sums AS (SELECT conv_id, turn, line_no, list(s ORDER BY i) AS vec FROM (SELECT conv_id, turn, line_no, i, round(sum(x), 6) AS s FROM parts GROUP BY ALL) GROUP BY ALL)",
        "filled AS (SELECT conv_id, turn, line_no, coalesce(vec, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS vec FROM talk LEFT JOIN sums USING (conv_id, turn, line_no))",
        f"SELECT conv_id, turn, line_no, {o.FLAT} FROM filled",
    )
)
def sentence_vectors(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    said = said.withColumn("line_no", F.col("line_no").cast("bigint"))
    key = ("conv_id", "turn", "line_no")
    rows = similarity.sentence_vectors(said, corpus.tokenise(said, *key), _model_of_vocab(spark, sf_dir), *key)
    return _flat(rows.withColumn("vec", F.transform("vec", lambda x: F.round(x, 6))), *key)


@query(
    o.sql(
        o.MODEL,
        "parts AS (SELECT unnest(range(64)) AS i, unnest(vec) AS x FROM model)",
        "means AS (SELECT list(m ORDER BY i) AS vec FROM (SELECT i, round(avg(x), 6) AS m FROM parts GROUP BY i))",
        f"SELECT (SELECT round(avg(bias), 6) FROM model) AS bias, {o.FLAT} FROM means",
    )
)
def mean_vector(spark, sf_dir):
    rows = similarity.mean_word(_model(spark, sf_dir))
    return _flat(rows.select(F.round("bias", 6).alias("bias"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec")), "bias")


def _step_updates(model):
    """The disjoint pairs (2k, 2k + 1) of all rows of the model."""
    right = model.select(F.col("id").alias("w2"))
    rows = model.where("id % 2 = 0").select(F.col("id").alias("w1"), (F.col("id") + 1).alias("w2")).join(right, "w2", "left_semi")
    even = F.col("w1") % 4 == 0
    return rows.select("w1", "w2", F.when(even, 1.0).otherwise(0.0).alias("pos"), F.when(even, 0.0).otherwise(1.0).alias("neg"))


@query(
    o.sql(
        o.MODEL,
        o.STEP,
        "scored AS (SELECT s.*, 1 / (1 + exp(-(list_dot_product(x.vec, y.vec) + y.bias))) AS q FROM step s JOIN model x ON x.id = w1 JOIN model y ON y.id = w2)",
        "SELECT round(sum(CASE WHEN q > 0 AND q < 1 THEN -(pos * ln(q) + neg * ln(1 - q)) ELSE 0 END), 4) AS cost, count(*) FILTER (pos * (1 - q) - neg * q <> 0) AS updates FROM scored",
    )
)
def model_cost(spark, sf_dir):
    model = _model(spark, sf_dir)
    rows = training.model_cost(_step_updates(model), model)
    return rows.select(F.round("cost", 4).alias("cost"), "updates")


@query(o.sql(o.MODEL, o.STEP, o.MOVED, o.told("moved"), f"SELECT id, bias, grad, {o.FLAT} FROM told"))
def adagrad_step(spark, sf_dir):
    model = _model(spark, sf_dir)
    return _told(training.adagrad_step(_step_updates(model), model))


def _told(rows):
    rows = rows.select("id", F.round("bias", 6).alias("bias"), F.round("grad", 6).alias("grad"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))
    return _flat(rows, "id", "bias", "grad")


def _numbered(updates):
    return updates.withColumn("origin", F.lit("observed"))


@query(o.sql(o.MODEL, o.STEP, o.MOVED, "after AS (SELECT id, bias, grad, vec FROM moved UNION ALL SELECT id, bias, grad, vec FROM model ANTI JOIN moved USING (id))", o.told("after"), f"SELECT id, bias, grad, {o.FLAT} FROM told"))
def train_epoch_disjoint(spark, sf_dir):
    """An epoch of the trainer over updates that share no word, in several tasks: their order is of no account."""
    model = _model(spark, sf_dir)
    return _told(training.train_epoch(model, _numbered(_step_updates(model)), tasks=4)[0])


@query(o.sql(o.MODEL, o.STEP, o.MOVED, "after AS (SELECT id, bias, grad, vec FROM moved UNION ALL SELECT id, bias, grad, vec FROM model ANTI JOIN moved USING (id))", o.told("after"), f"SELECT id, bias, grad, {o.FLAT} FROM told"))
def train_epoch_blocks(spark, sf_dir):
    """The same by blocks of words, as for models too large to send to every task."""
    model = _model(spark, sf_dir)
    return _told(training.train_epoch_blocks(model, _numbered(_step_updates(model)), blocks=6)[0])


@query(o.sql(o.VOCAB, "made AS (SELECT id, list_transform(range(1, 9), lambda i: (('0x' || substr(md5(concat_ws('|', '0', 'init', id, i)), 1, 4))::INT / 65536.0::DOUBLE - 0.5) / 8.0::DOUBLE) AS vec FROM vocab)", f"SELECT id, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS grad, {o.FLAT} FROM made"))
def initial_model(spark, sf_dir):
    return _flat(training.initial_model(_vocab(spark, sf_dir), 8), "id", "bias", "grad")


@query(o.sql(o.VOCAB, "made AS (SELECT id, [id + 0.5::DOUBLE, id * 2.0::DOUBLE] AS vec FROM vocab)", f"SELECT id, {o.FLAT} FROM made"))
def initial_model_by_callable(spark, sf_dir):
    """Components by a caller's own rule."""
    rule = lambda word, i: F.when(i == 1, word + 0.5).otherwise(word * 2.0)
    return _flat(training.initial_model(_vocab(spark, sf_dir), 2, draw=rule), "id")


@query(o.sql(o.MODEL, f"SELECT id, bias, 1e-12::DOUBLE AS grad, {o.FLAT} FROM model"))
def reset_history(spark, sf_dir):
    return _flat(training.reset_history(_model(spark, sf_dir)), "id", "bias", "grad")


@query(o.sql(o.MODEL, o.QUESTIONS, "SELECT qid, pos, target, candidate, round(sim, 6) AS sim, in_dict FROM scores"))
def question_scores(spark, sf_dir):
    rows = evaluation.question_scores(_questions(spark), _model(spark, sf_dir), _antonym_ids(spark))
    return rows.select("qid", "pos", "target", "candidate", F.round("sim", 6).alias("sim"), "in_dict")


@query(o.sql(o.MODEL, o.QUESTIONS, o.ANSWERS, "SELECT qid, chosen, answer, correct FROM answers"))
def question_answers(spark, sf_dir):
    asked = _questions(spark)
    return evaluation.question_answers(asked, evaluation.question_scores(asked, _model(spark, sf_dir)))


@query(
    o.sql(
        o.MODEL, o.QUESTIONS, o.ANSWERS,
        "tally AS (SELECT 100::BIGINT AS total, count(*) AS answered, count(*) FILTER (correct) AS correct FROM answers)",
        "rates AS (SELECT *, correct::DOUBLE / answered AS \"precision\", correct::DOUBLE / total AS recall FROM tally)",
        'SELECT total, answered, correct, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(2 * "precision" * recall / ("precision" + recall), 9) AS f FROM rates',
    )
)
def eval_metrics(spark, sf_dir):
    asked = _questions(spark)
    answers = evaluation.question_answers(asked, evaluation.question_scores(asked, _model(spark, sf_dir)))
    rows = evaluation.metrics(asked, answers)
    return rows.select("total", "answered", "correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f")))


@query(
    o.sql(
        "cut AS (SELECT vec_id AS line_no, 'w' || (vec_id % 400) AS word, embedding::DOUBLE[] AS vec FROM embeddings)",
        "kept AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY word ORDER BY line_no) = 1)",
        "numbered AS (SELECT row_number() OVER (ORDER BY line_no) - 1 AS id, word, vec FROM kept)",
        f"SELECT id, word, {o.FLAT} FROM numbered",
    )
)
def vector_text_import(spark, sf_dir):
    numbers = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    lines = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("W"), F.col("vec_id") % 400), F.array_join(numbers, " ")).alias("line")
    )
    return _flat(corpus.vector_lines(lines), "id", "word")


@query(o.sql(o.MODEL, f"SELECT id, word, bias, grad, 3 AS epochs, {o.FLAT} FROM model"))
def model_roundtrip(spark, sf_dir):
    path = f"{storage.shared_dir(spark)}/antipode/model-{uuid.uuid4().hex}"
    storage.remove_at_exit(spark, path)
    storage.save_model(_model(spark, sf_dir), path, 3)
    model, epochs = storage.load_model(spark, path)
    return _flat(model.withColumn("epochs", F.lit(epochs)), "id", "word", "bias", "grad", "epochs")


def _folder(spark, name):
    path = f"{storage.shared_dir(spark)}/antipode/{name}-{uuid.uuid4().hex}"
    storage.remove_at_exit(spark, path)
    return path


@query(o.sql(o.COUNTS, 'SELECT word, "count" FROM counts'))
def corpus_files_counts(spark, sf_dir):
    """Word counts of a folder of gzip files, one sentence a line, that the documents were written to."""
    path = _folder(spark, "corpus")
    _sentences(spark, sf_dir).select(F.col("line").alias("value")).write.option("compression", "gzip").text(path)
    return vocabulary.word_counts(corpus.tokenise(corpus.read_corpus(spark, path)))


@query(o.sql(o.VOCAB, """SELECT id, word, "count", (SELECT sum("count") FROM vocab) AS total FROM vocab"""))
def vocabulary_file_roundtrip(spark, sf_dir):
    """The native vocabulary file, written and read; its total is that of the words read."""
    path = _folder(spark, "vocabulary")
    storage.write_vocabulary_file(_vocab(spark, sf_dir), path)
    rows = storage.read_vocabulary_file(spark, path)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("count").alias("total"))))


@query(o.sql(o.VOCAB, o.pairs(WINDOW, 1), 'SELECT w1, w2, "count" FROM cooc'))
def cooccurrence_file_roundtrip(spark, sf_dir):
    """The native co-occurrence file, written and read."""
    path = _folder(spark, "cooccurrence")
    storage.write_cooccurrence_file(_cooc(spark, sf_dir, _vocab(spark, sf_dir)), path)
    return storage.read_cooccurrence_files(spark, path)


@query(o.sql(o.MODEL, f"SELECT id, bias, grad, 3 AS epochs, {o.FLAT} FROM model"))
def model_file_roundtrip(spark, sf_dir):
    """The native model file, written and read."""
    path = _folder(spark, "model-file")
    storage.write_model_file(_model(spark, sf_dir), path, 3)
    model, epochs = storage.read_model_file(spark, path)
    return _flat(model.withColumn("epochs", F.lit(epochs)), "id", "bias", "grad", "epochs")


@query(o.sql(o.MODEL, f"SELECT word, bias, {o.FLAT} FROM model"))
def text_model_roundtrip(spark, sf_dir):
    """The text model, written and read: a line's last number is the bias."""
    path = _folder(spark, "text-model")
    storage.save_text_model(_model(spark, sf_dir), path)
    rows = corpus.vector_lines(corpus.read_lines(spark, f"{path}/words").withColumn("line_no", F.monotonically_increasing_id()))
    last = F.size("vec")
    return _flat(rows.select("word", F.get("vec", last - 1).alias("bias"), F.slice("vec", F.lit(1), last - 1).alias("vec")), "word", "bias")


def _trainable(spark, sf_dir):
    """The initial model of the whole vocabulary, and the whole update table."""
    vocab, cooc, stats = _training_inputs(spark, sf_dir)
    rows = updates.update_table(cooc, stats, _thesaurus(vocab))
    return training.initial_model(vocab, 8), storage.written(rows, "updates")


@query()
def train_epoch(spark, sf_dir):
    """Tests replay the sequential rule."""
    return training.train(*_trainable(spark, sf_dir), epochs=1, tasks=2)[0]


@query()
def train_resume(spark, sf_dir):
    """Two epochs, the second from the saved model."""
    model, rows = _trainable(spark, sf_dir)
    path = f"{storage.shared_dir(spark)}/antipode/model-{uuid.uuid4().hex}"
    storage.remove_at_exit(spark, path)
    storage.save_model(training.train(model, rows, epochs=1, tasks=2)[0], path, 1)
    model, done = storage.load_model(spark, path)
    return training.train(model, rows, epochs=1, tasks=2, done=done)[0]
