"""Run catalogued queries and their oracles on one scale, and compare the rows."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return repr(value)


def differences(spark_rows, spark_columns, oracle_rows, oracle_columns) -> list[str]:
    if sorted(spark_columns) != sorted(oracle_columns):
        return [f"columns {sorted(spark_columns)} vs {sorted(oracle_columns)}"]
    order = sorted(spark_columns)
    left = sorted(tuple(_plain(r[spark_columns.index(c)]) for c in order) for r in spark_rows)
    right = sorted(tuple(_plain(r[oracle_columns.index(c)]) for c in order) for r in oracle_rows)
    problems = []
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        problems.append(f"order {order}; only spark {sorted(a - b)[:3]}; only oracle {sorted(b - a)[:3]}"[:1500])
    return problems


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def check(spark, connection, build, sql, sf_dir) -> tuple[list[str], float, float, int]:
    start = time.time()
    frame = build(spark, sf_dir)
    rows = frame.collect()
    middle = time.time()
    if sql is None:
        return ([] if rows else ["no rows"]), middle - start, 0.0, len(rows)
    result = connection.sql(sql)
    oracle_rows = result.fetchall()
    end = time.time()
    problems = differences([tuple(r) for r in rows], frame.columns, oracle_rows, result.columns)
    kinds = {c: str(t) for c, t in zip(result.columns, result.types)}
    for field in frame.schema.fields:
        expected = KINDS.get(field.dataType.simpleString())
        if expected != kinds.get(field.name):
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} vs {kinds.get(field.name)}")
    return problems, middle - start, end - middle, len(rows)


def main() -> None:
    import __spark_entry__ as entry
    from millwarden.session import local_session

    sf_dir, names = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    chosen = [n for n in queries if not names or n in names or any(p.endswith(":") and queries[n].__module__.endswith(p[:-1]) for p in names)]
    bad = 0
    for name in chosen:
        try:
            problems, took, oracle_took, count = check(spark, connection, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            problems, took, oracle_took, count = [f"{type(error).__name__}: {str(error)[:900]}"], 0.0, 0.0, -1
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} rows={count} {took:.2f}s oracle={'%.2fs' % oracle_took if name in oracles else 'none'}", flush=True)
        for problem in problems:
            print("    ", problem, flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main()
