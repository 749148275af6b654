"""Compares a query with its SQL in DuckDB, column by column, regardless of order."""

import glob
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            files = p if os.path.isfile(p) else sorted(glob.glob(p + "/*.parquet"))
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return c


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        return (1, repr(v) if v != int(v) else int(v)) if v == v and abs(v) < 1e15 else (1, repr(v))
    if isinstance(v, int):
        return (1, v)
    return (2, str(v))


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted((tuple(norm(v) for v in r) for r in df.select(cols).collect()), key=str)
    rel = duck(sf_dir).sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols, (cols, names)
    at = [names.index(c) for c in cols]
    right = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    return cols, left, right


def assert_same(spark, query, sql, sf_dir):
    cols, left, right = both(spark, query, sql, sf_dir)
    assert len(left) == len(right), (len(left), len(right), left[:2], right[:2])
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    assert not bad, (cols, len(bad), bad[:3])
    return len(left)
