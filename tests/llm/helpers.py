"""Small inputs with the awkward cases: nulls, empty texts, repeats, clashing columns."""

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).df()


def same(left, right):
    """Equal rows and columns, whatever their order; numbers to six digits, missing values alike."""
    def value(x):
        if pd.isna(x):
            return "<null>"
        return f"{x:.6g}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)

    def rows(df):
        return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))

    assert sorted(left.columns) == sorted(right.columns)
    return rows(left) == rows(right)
