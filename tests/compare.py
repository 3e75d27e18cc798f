"""Compares a DataFrame with DuckDB's answer to a query over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return None if v is None or type(v).__name__ in ("NAType", "NaTType") else v


def rows(columns, records):
    key = lambda r: tuple((x is None, str(float(x)) if isinstance(x, (int, float)) else str(x)) for x in r)
    return sorted((tuple(plain(v) for v in r) for r in records), key=key)


def differences(df, sql, sf_dir):
    got = df.toPandas()
    expected = connection(sf_dir).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = (rows(columns, t[columns].itertuples(index=False)) for t in (got, expected))
    assert len(a) == len(b)
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]
