"""Runs a query's DuckDB SQL and compares its rows with Spark's."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub" or df[c].map(lambda v: type(v).__name__ == "Decimal").any():
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str).replace({"None": "nan", "<NA>": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_equal(spark_rows: pd.DataFrame, sql: str, data: str) -> None:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = con.execute(sql).df()
    assert sorted(spark_rows.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(_plain(spark_rows), _plain(expected), check_dtype=False, rtol=1e-7, atol=1e-9)
