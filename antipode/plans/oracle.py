"""Parts of the SQL that states the queries' results. Each part is one or more named tables; ``sql`` puts them together."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The components of a vector, one row each.
FLAT = "unnest(range(len(vec)))::BIGINT AS i, unnest(vec) AS x"


def split(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({column}, '{UPPER}', '{LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def sql(*parts: str) -> str:
    seen = list(dict.fromkeys(p for part in parts[:-1] for p in ([part] if isinstance(part, str) else part)))
    return f"WITH {', '.join(seen)} {parts[-1]}"


SENTENCES = (
    "sentences AS MATERIALIZED (SELECT doc_id, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))",
)
TOKENS = (*SENTENCES, f"tokens AS MATERIALIZED (SELECT doc_id, line_no, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS word FROM (SELECT doc_id, line_no, {split('line')} AS t FROM sentences))")
COUNTS = (*TOKENS, 'counts AS MATERIALIZED (SELECT word, count(*)::DOUBLE AS "count" FROM tokens GROUP BY word)')
VOCAB = (*COUNTS, """vocab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY "count" DESC, word) - 1 AS id, word, "count" FROM (SELECT *, rank() OVER (ORDER BY "count" DESC) AS r FROM counts) WHERE r <= 1001)""")


def pairs(window: int, weight: int, symmetric: bool = True) -> tuple[str, ...]:
    of = {0: "1.0::DOUBLE", 1: "1.0::DOUBLE / {d}", 2: "1.0::DOUBLE + (1.0::DOUBLE - {d}) / {w}"}[weight]
    n = ", ".join(f"count(*) FILTER (d = {d}) AS n_{d}" for d in range(1, window + 1))
    total = "0.0::DOUBLE" + "".join(f" + n_{d}::DOUBLE * ({of.format(d=d, w=window)})" for d in range(1, window + 1))
    ways = "SELECT w1, w2, d FROM near" + (" UNION ALL SELECT w2, w1, d FROM near" if symmetric else "")
    return (
        "encoded AS MATERIALIZED (SELECT doc_id, line_no, pos, id FROM tokens JOIN vocab USING (word))",
        f"near AS MATERIALIZED (SELECT a.id AS w1, b.id AS w2, b.pos - a.pos AS d FROM encoded a JOIN encoded b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos > a.pos AND b.pos <= a.pos + {window})",
        f'cooc AS MATERIALIZED (SELECT w1, w2, {total} AS "count" FROM (SELECT w1, w2, {n} FROM ({ways}) GROUP BY w1, w2))',
    )


STATS = (
    *VOCAB,
    *pairs(5, 1),
    'kept AS MATERIALIZED (SELECT id, "count", least(CASE WHEN s > 0 THEN (sqrt(s) + 1) / s ELSE 1 END, 1.0::DOUBLE) AS keep_p, pow("count", 0.75) AS neg_w FROM (SELECT *, "count" / (1e-3::DOUBLE * sum("count") OVER ()) AS s FROM vocab))',
    "weighted AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY neg_w DESC, id) AS rank, sum(neg_w) OVER () AS neg_total FROM kept)",
    'sampled AS MATERIALIZED (SELECT w1 AS id, sum(c."count" * x.keep_p * y.keep_p) AS sub_count FROM cooc c JOIN kept x ON x.id = w1 JOIN kept y ON y.id = w2 GROUP BY w1)',
    "stats AS MATERIALIZED (SELECT w.*, coalesce(s.sub_count, 0) AS sub_count, coalesce(s.sub_count, 0) * 5.0::DOUBLE / neg_total AS scale FROM weighted w LEFT JOIN sampled s USING (id))",
)
EXPECTED = ('expected AS MATERIALIZED (SELECT w1, w2, c."count" * x.keep_p * y.keep_p AS pos_e, x.scale * y.neg_w AS neg_e FROM cooc c JOIN stats x ON x.id = w1 JOIN stats y ON y.id = w2)',)
THESAURUS = (
    """pairs AS MATERIALIZED (SELECT x.id AS a, x.id + 1 AS b, kind FROM vocab x JOIN vocab y ON y.id = x.id + 1, (VALUES ('syn'), ('ant')) k(kind)
      WHERE (kind = 'syn' AND x.id % 4 = 0) OR (kind = 'ant' AND (x.id % 8 = 0 OR x.id % 4 = 2)))""",
    "ways AS MATERIALIZED (SELECT a AS w1, b AS w2, kind FROM pairs UNION ALL SELECT b, a, kind FROM pairs)",
)


def uniform(tag: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '0', '{tag}', w1, w2)), 1, 4))::INT / 65536.0::DOUBLE)"


def rounded(x: str, tag: str) -> str:
    return f"CASE WHEN {x} < 1e-5 THEN 0.0::DOUBLE WHEN {x} < 1 THEN CASE WHEN {uniform(tag)} < {x} THEN 1.0 ELSE 0.0 END ELSE {x} END"


OBSERVED = (
    f"drawn AS MATERIALIZED (SELECT w1, w2, {rounded('pos_e', 'pos')} AS pos, {rounded('neg_e', 'neg')} AS neg FROM expected)",
    "observed AS MATERIALIZED (SELECT d.w1, d.w2, d.pos, d.neg FROM drawn d ANTI JOIN ways w ON d.w1 = w.w1 AND d.w2 = w.w2 WHERE d.pos > 0 OR d.neg > 0)",
)
IMPLICIT = (
    "meant AS MATERIALIZED (SELECT x.id AS w1, y.id AS w2, x.scale * y.neg_w AS e FROM stats x JOIN stats y ON x.scale > 0 AND y.neg_w >= 1e-5::DOUBLE / x.scale AND y.rank < (SELECT count(*) FROM stats))",
    f"cast_lots AS MATERIALIZED (SELECT w1, w2, CASE WHEN e < 1 THEN CASE WHEN {uniform('implicit')} < e THEN 1.0 ELSE 0.0 END ELSE e END AS neg FROM meant)",
    "implicit AS MATERIALIZED (SELECT m.w1, m.w2, 0.0::DOUBLE AS pos, m.neg FROM (SELECT * FROM cast_lots WHERE neg > 0) m ANTI JOIN cooc c ON m.w1 = c.w1 AND m.w2 = c.w2 ANTI JOIN ways w ON m.w1 = w.w1 AND m.w2 = w.w2)",
)
SAID = (
    """said AS MATERIALIZED (SELECT s.w1, s.w2, 100.0::DOUBLE AS pos, 0.0::DOUBLE AS neg, 'syn' AS origin FROM (SELECT * FROM ways WHERE kind = 'syn') s ANTI JOIN (SELECT * FROM ways WHERE kind = 'ant') t ON s.w1 = t.w1 AND s.w2 = t.w2
      UNION ALL SELECT w1, w2, 0.0, 1305702::DOUBLE / 408302 * 100, 'ant' FROM ways WHERE kind = 'ant')""",
)
UPDATES = (
    "updates AS MATERIALIZED (SELECT w1, w2, pos, neg, 'observed' AS origin FROM observed UNION ALL SELECT w1, w2, pos, neg, 'implicit' FROM implicit UNION ALL SELECT * FROM said)",
)

MODEL = ("model AS MATERIALIZED (SELECT vec_id AS id, 'w' || vec_id AS word, (label - 2) / 10.0::DOUBLE AS bias, 0.0::DOUBLE AS grad, embedding::DOUBLE[] AS vec FROM embeddings)",)


def similarity(x: str, y: str) -> str:
    dot = f"list_dot_product({x}.vec, {y}.vec)"
    return f"(0.5::DOUBLE * (1 / (1 + exp(-({dot} + {x}.bias))) + 1 / (1 + exp(-({dot} + {y}.bias)))))"


def similar(order: str) -> str:
    sim = similarity("x", "y")
    return f"""SELECT query, rank, word, round(sim, 6) AS similarity FROM (
      SELECT query, word, sim, row_number() OVER (PARTITION BY query ORDER BY sim {order}, id) AS rank FROM (
        SELECT x.word AS query, y.id, y.word, {sim} AS sim FROM model x JOIN model y ON x.id <> y.id WHERE x.id % 20 = 0)) WHERE rank <= 10"""


STEP = ("step AS (SELECT x.id AS w1, y.id AS w2, CASE WHEN x.id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS pos, CASE WHEN x.id % 4 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS neg FROM model x JOIN model y ON x.id % 2 = 0 AND y.id = x.id + 1)",)
MOVED = (
    """scored AS (SELECT s.*, x.vec AS e1, y.vec AS e2, x.bias AS b1, y.bias AS b2,
         1 / (1 + exp(-(list_dot_product(x.vec, y.vec) + y.bias))) AS q FROM step s JOIN model x ON x.id = w1 JOIN model y ON y.id = w2)""",
    "differing AS (SELECT *, pos * (1 - q) - neg * q AS diff FROM scored)",
    """grown AS (SELECT *, list_dot_product(e2, e2) / 65.0::DOUBLE * diff * diff AS g1, (list_dot_product(e1, e1) + 1) / 65.0::DOUBLE * diff * diff AS g2 FROM differing WHERE diff <> 0)""",
    "stepped AS (SELECT *, 0.03::DOUBLE * diff / sqrt(g1) AS s1, 0.03::DOUBLE * diff / sqrt(g2) AS s2 FROM grown)",
    """moved AS (SELECT w1 AS id, b1 AS bias, g1 AS grad, list_transform(list_zip(e1, e2), lambda p: p[1] + s1 * p[2]) AS vec FROM stepped
      UNION ALL SELECT w2, b2 + s2, g2, list_transform(list_zip(e2, e1), lambda p: p[1] + s2 * p[2]) FROM stepped)""",
)


def told(table: str) -> str:
    return f"told AS (SELECT id, round(bias, 6) AS bias, round(grad, 6) AS grad, list_transform(vec, lambda x: round(x, 6)) AS vec FROM {table})"


QUESTIONS = (
    "asked AS (SELECT q AS qid, j - 1 AS pos, 'w' || q AS target, 'w' || ((q * 7 + j * 13) % 600) AS candidate, (q * 7 + j * 13) % 600 AS cid, 'w' || ((q * 7 + (q % 5 + 1) * 13) % 600) AS answer FROM range(100) a(q), range(1, 6) b(j))",
    "known AS (SELECT qid, pos, target, candidate, cid, answer, x.vec AS xv, x.bias AS xb, y.vec AS yv, y.bias AS yb FROM asked JOIN model x ON x.word = target LEFT JOIN model y ON y.word = candidate)",
    """scores AS MATERIALIZED (SELECT qid, pos, target, candidate, answer,
       0.5::DOUBLE * (1 / (1 + exp(-(list_dot_product(xv, yv) + xb))) + 1 / (1 + exp(-(list_dot_product(xv, yv) + yb)))) AS sim,
       yv IS NOT NULL AND EXISTS (SELECT 1 FROM range(100) r(k) WHERE least(k, (k * 7 + 13) % 600) = least(qid, cid) AND greatest(k, (k * 7 + 13) % 600) = greatest(qid, cid)) AS in_dict FROM known)""",
)
ANSWERS = (
    "answers AS MATERIALIZED (SELECT qid, chosen, answer, chosen = answer AS correct FROM (SELECT qid, first(answer) AS answer, arg_min(candidate, {'s': sim, 'p': pos}) AS chosen, bool_or(sim IS NULL) AS lost FROM scores GROUP BY qid) WHERE NOT lost)",
)
