"""Spark results against DuckDB's, without order, floats to 6 places."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def _text(x):
    if isinstance(x, float):
        return f"{x:.6f}"
    return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(_text, r)) for r in df[columns].itertuples(index=False))
