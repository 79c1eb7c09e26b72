"""Compares a query's rows with those of its SQL in DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "is_finite"):
        return round(float(v), 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr), [columns[i] for i in order]


def compare(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    df = query(spark, sf_dir)
    got, got_names = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want, want_names = rows(names, found.fetchall())
    assert got_names == want_names
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]
