"""The operators over their whole tables, and the SQL that states the same result where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, licenses, near_jaccard, packing, quality, suffix_dedup, token_counts, toxicity
from .common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_license_scan(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"), licenses.templates(spark))


@query
def op2_importance_resampling(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
SELECT doc_id,
  max(doc_id) OVER same AS keep_id,
  count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    return near_jaccard.component_report(table(spark, sf_dir, "documents"), words=4, percent=85)


ORACLES["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut
), flat AS MATERIALIZED (SELECT r, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS o FROM flat x JOIN flat y ON x.x = y.x AND x.r <> y.r GROUP BY ALL)
  JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE 100 * o >= 85 * (len(p.s) + len(q.s) - o)
), reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.a JOIN sets t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.s
"""


@query
def op5_chat_formatting(spark, sf_dir):
    own = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    said = chat.chat_format(chat.as_events(rows)).withColumn("turns", chat.read_back(F.col("formatted")))
    learnt = F.transform("loss", lambda s: chat.unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return said.withColumn("learnt", F.concat_ws("", learnt)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op5_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(20 + length(replace(replace(replace(role || text, '\', '\b'), '[', '\s'), '<', '\l')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


@query
def op6_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@query
def op8_suffix_array_dedup(spark, sf_dir):
    rows = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLES["op8_suffix_array_dedup"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i FROM d),
strings AS MATERIALIZED (SELECT r, doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM starts),
least_of AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
hits AS (SELECT r, i FROM strings JOIN least_of USING (s) WHERE doc_id > m),
marked AS (SELECT r, i, coalesce(i > lag(i) OVER w + 50, true) AS opens FROM hits WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM runs),
cut AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(h, (2 * e + 1)::BIGINT, (2 * (a - e))::BIGINT), '' ORDER BY a) AS front
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN front IS NULL THEN h ELSE front || substr(h, (2 * e + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
