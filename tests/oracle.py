"""Compare a Spark result with DuckDB SQL over the same Parquet tables, whatever the row order."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def _text(v: object) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    for c in columns:
        if frame[c].dtype.kind == "f" and (frame[c].dropna() % 1 == 0).all():
            plain[c] = [None if v != v else int(v) for v in frame[c]]
        elif str(frame[c].dtype).startswith("datetime"):
            plain[c] = frame[c].astype("datetime64[us]").astype(str)
    return sorted(tuple(_text(v) for v in r) for r in plain.itertuples(index=False))


def assert_same(spark_df, sql: str, folder: str) -> None:
    own, other = spark_df.toPandas(), connect(folder).execute(sql).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)
