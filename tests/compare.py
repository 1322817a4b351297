"""Rows of Spark against rows of DuckDB."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c.execute(sql).fetchdf()


def shown(frame):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    names = sorted(frame.columns)
    return names, sorted((tuple(one(v) for v in row) for row in frame[names].itertuples(index=False)), key=repr)
