"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        file = f"{sf_dir}/{name}.parquet"
        if os.path.exists(file):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if value != value else (int(value) if value == int(value) else round(value, 6))
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat()
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)
    return sorted((tuple(_plain(v) for v in r) for r in pdf[columns].itertuples(index=False, name=None)), key=repr)


def difference(got: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """``None`` when equal, otherwise a short description."""
    spark_pdf = got.toPandas()
    sql_pdf = con.execute(sql).df()
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"
    left, right = rows(spark_pdf), rows(sql_pdf)
    if left == right:
        return None
    extra = [r for r in left if r not in set(right)][:2]
    missing = [r for r in right if r not in set(left)][:2]
    return f"rows {len(left)} vs {len(right)}; only here {extra}; only there {missing}"
