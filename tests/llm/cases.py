"""Rows that every operator over documents must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta"),
    (2, "alpha beta gamma delta epsilon zeta"),
    (2, "alpha beta gamma delta epsilon zeta"),
    (3, None),
    (4, ""),
    (None, "a text without an id that is somewhat long, longer than fifty bytes"),
    (None, None),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG + "tail"),
    (8, "é漢字 \U0001f600 <|endoftext|> it's"),
]
#: Names that operators use inside.
EXTRA = {"sender": 1, "docno": 2, "_row": 3, "_class": 4, "rep": 5, "doc": 6, "score": 7, "key": 8, "_fp": 9, "n": 10}


def documents(spark, rows=ROWS):
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], schema).repartition(3)


def empty(spark):
    return documents(spark).limit(0)
