"""Spark results against DuckDB's."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def answer(sql: str, sf: str, **own: pd.DataFrame) -> pd.DataFrame:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        f = f"{sf}/{t}.parquet"
        if t in own:
            c.register(t, own[t])
        else:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if isinstance(x, (list, np.ndarray)):
            return tuple(map(plain, x))
        if x is None or (not isinstance(x, (tuple, dict)) and pd.isna(x)):
            return ""
        return f"{x:.5f}" if isinstance(x, (float, np.floating)) and x != int(x if abs(x) < 1e15 else 0) else str(int(x)) if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) and x == x and abs(x) < 1e15 else str(x)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
