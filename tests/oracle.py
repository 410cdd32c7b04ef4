"""Runs a registered query in Spark and its SQL in DuckDB, and compares the rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x: object) -> str:
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    try:
        return f"{float(x):.10g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(df.columns)
    return sorted(tuple(value(x) for x in r) for r in df[names].itertuples(index=False))


def compare(spark, query, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(sql).df(), query(spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
