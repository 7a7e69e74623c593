"""Run registered queries in Spark and their oracle in DuckDB and compare the tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def close(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, float) and not exact:
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-6)
    return type(a) is type(b) and a == b


def difference(spark_df, connection, sql: str, exact: bool = False) -> str | None:
    """None when both tables agree, else a short description."""
    result = connection.execute(sql)
    oracle_columns = [d[0] for d in result.description]
    expected = normal_rows(oracle_columns, result.fetchall())
    columns = spark_df.columns
    if sorted(columns) != sorted(oracle_columns):
        return f"columns {sorted(columns)} != {sorted(oracle_columns)}"
    actual = normal_rows(columns, [tuple(r) for r in spark_df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    for a, e in zip(actual, expected):
        if len(a) != len(e) or not all(close(x, y, exact) for x, y in zip(a, e)):
            return f"{sorted(columns)}: {a} != {e}"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    from claimsieve.catalog import ORACLES, QUERIES
    from claimsieve.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                found = difference(frame, connection, ORACLES[name], exact=True) or "ok"
            else:
                found = f"rows {len(frame.collect())} (no oracle)"
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += not (found == "ok" or found.startswith("rows") and "no oracle" in found)
        print(f"{name:32s} {time.time() - start:6.2f}s {found[:900]}", flush=True)
    print(f"{failed} failed of {len(names or QUERIES)}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
