"""Rows of a query beside those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(base):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else None if x is None else str(x)
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    got = con.execute(sql)
    want = canonical([c[0] for c in got.description], got.fetchall())
    have = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    assert have[1] == want[1]
