"""Spark-vs-DuckDB result comparison used by the tests and ``check.py``.

Rows are compared as multisets after sorting columns by name; floats are rounded.
Only small (sf0.01) results are collected here — this is a test tool, not an operator.
"""

from __future__ import annotations

import math
from collections import Counter

from scanhouse.plans.fixtures import TABLE_NAMES


def duckdb_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


DECIMALS = 6


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if DECIMALS is None else round(v, DECIMALS)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


# Spark type name -> DuckDB type name, for the schema part of the comparison
SPARK_TO_DUCKDB = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_mismatches(spark_df, con, sql: str) -> list:
    oracle = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for f in spark_df.schema.fields:
        name = f.dataType.simpleString()
        if SPARK_TO_DUCKDB.get(name, name) != oracle.get(f.name):
            out.append((f.name, name, oracle.get(f.name)))
    return out


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, reason=f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}")
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}

    def s_key(r):
        return tuple(_norm(r[i]) for i in order)

    def d_key(r):
        return tuple(_norm(r[d_index[s_cols[i]]]) for i in order)

    cs, cd = Counter(map(s_key, s_rows)), Counter(map(d_key, d_rows))
    types = type_mismatches(spark_df, con, sql)
    ok = cs == cd and not types
    out["ok"] = ok
    if types:
        out["type_mismatches"] = types
    if not ok:
        out["only_spark"] = [repr(x) for x in list((cs - cd).elements())[:3]]
        out["only_oracle"] = [repr(x) for x in list((cd - cs).elements())[:3]]
    return out
