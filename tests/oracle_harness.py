"""Run a Spark query and its DuckDB oracle on the same Parquet tables and
compare row count, column names/kinds and an order-insensitive value hash."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

import duckdb
import numpy as np

from catalytics.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (np.generic,)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") if v != 0 else 0.0
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in records]


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in sorted(repr(x) for x in rows):
        h.update(r.encode())
    return h.hexdigest()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "timestamp_ntz": "TIMESTAMP"}


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in spark_df.schema.fields}
    s_rows = rows_of(s_cols, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    o_cols = list(rel.columns)
    o_types = dict(zip(o_cols, [str(t) for t in rel.types]))
    o_rows = rows_of(o_cols, rel.fetchall())
    out = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "columns_match": sorted(s_cols) == sorted(o_cols),
           "types_match": s_types == o_types,
           "hash_match": digest(s_rows) == digest(o_rows)}
    if not out["types_match"]:
        out["type_diffs"] = {c: (s_types[c], o_types.get(c)) for c in s_types if s_types[c] != o_types.get(c)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(o_cols)
    elif not out["hash_match"]:
        a, b = set(map(repr, s_rows)), set(map(repr, o_rows))
        out["only_spark"] = sorted(a - b)[:3]
        out["only_oracle"] = sorted(b - a)[:3]
    out["ok"] = (out["columns_match"] and out["types_match"] and out["hash_match"]
                 and len(s_rows) == len(o_rows))
    return out
