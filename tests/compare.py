import numpy as np


def plain(v):
    if isinstance(v, np.ndarray | list):
        return [plain(x) for x in v]
    if hasattr(v, "item"):
        v = v.item()
    return None if v != v else v


def same(spark_frame, duck, sql):
    """Asserts that a DataFrame and a SQL query give the same rows in any order."""
    rows = spark_frame.collect()
    names = sorted(spark_frame.columns)
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    ours = sorted(repr([plain(r[c]) for c in names]) for r in rows)
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in cursor.fetchall())
    assert ours == theirs
