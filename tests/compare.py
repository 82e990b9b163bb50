"""Side-by-side comparison of a Spark query and its DuckDB twin."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def rows_of(rows, cols):
    return sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def assert_same(df, sql, sf_dir):
    names, want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    assert rows_of([r.asDict() for r in df.collect()], cols) == rows_of(want, cols)
