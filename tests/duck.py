"""Runs a query and its SQL side by side."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def same(df, connection, sql):
    """Asserts equal columns and rows, in any order."""
    rows, q = df.collect(), connection.execute(sql)
    names, theirs = [d[0] for d in q.description], q.fetchall()
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in sorted(names)]
    a = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows)
    b = sorted(tuple(plain(r[i]) for i in at) for r in theirs)
    assert len(a) == len(b)
    assert a == b
