"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the correctness gate: same row count, same column names, and the same
order-insensitive hash over the values (columns sorted by name).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

from ticketlens.sources.testdata import BASE_TABLES


def _canon(value) -> str:
    if value is None:
        return "\\N"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 9) + 0.0)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_canon(v) for v in value) + "]"
    return str(value)


def digest(columns: list[str], rows: list[tuple]) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_canon(row[i]) for i in order) for row in rows)
    h = hashlib.sha256("\n".join(lines).encode("utf-8")).hexdigest()
    return [columns[i] for i in order], len(rows), h


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def run_duck(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def run_spark(df):
    rows = df.collect()
    return list(df.columns), [tuple(r) for r in rows]


def compare(spark_result, duck_result) -> dict:
    s_cols, s_n, s_h = digest(*spark_result)
    d_cols, d_n, d_h = digest(*duck_result)
    return {
        "rows_spark": s_n,
        "rows_oracle": d_n,
        "rows_match": s_n == d_n,
        "schema_match": s_cols == d_cols,
        "hash_match": s_h == d_h and s_cols == d_cols,
        "columns_spark": s_cols,
        "columns_oracle": d_cols,
    }


def diff_rows(spark_result, duck_result, limit: int = 5) -> list:
    s_cols, s_rows = spark_result
    d_cols, d_rows = duck_result
    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    s = {"\x1f".join(_canon(r[i]) for i in order_s) for r in s_rows}
    d = {"\x1f".join(_canon(r[i]) for i in order_d) for r in d_rows}
    return [("spark_only", x) for x in sorted(s - d)[:limit]] + [("oracle_only", x) for x in sorted(d - s)[:limit]]
