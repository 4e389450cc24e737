"""Run every query in Spark and its SQL in DuckDB and compare the rows.

    python tools/compare.py [--sf /root/testdata/sf0.01] [--only name,name]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cpgspark.catalogue import load  # noqa: E402
from cpgspark.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _kind(value: object) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), "other")


def normal(value: object) -> object:
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(names_a: list[str], a: list[tuple], names_b: list[str], b: list[tuple]) -> str | None:
    """None if equal, else what differs first."""
    if sorted(names_a) != sorted(names_b):
        return f"columns {sorted(names_a)} != {sorted(names_b)}"
    if len(a) != len(b):
        return f"row count {len(a)} != {len(b)}"
    left, right = rows_of(names_a, a), rows_of(names_b, b)
    if left != right:
        return f"values: spark only {list((left - right))[:3]}, sql only {list((right - left))[:3]}"
    for i, name in enumerate(names_a):
        j = names_b.index(name)
        kinds = {_kind(r[i]) for r in a if r[i] is not None}, {
            _kind(r[j]) for r in b if r[j] is not None
        }
        if kinds[0] != kinds[1]:
            return f"types of {name}: {kinds}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    args = parser.parse_args()
    queries, sql = load()
    names = [n for n in args.only.split(",") if n] or list(queries)
    spark = get_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            df = queries[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.perf_counter() - start
            if name not in sql:
                verdict = f"rows only ({len(got)})"
            else:
                cursor = con.execute(sql[name])
                expected = cursor.fetchall()
                columns = [d[0] for d in cursor.description]
                problem = compare(df.columns, got, columns, expected)
                verdict = f"ok ({len(got)})" if problem is None else f"DIFFERS {problem}"
                bad += problem is not None
        except Exception as error:  # noqa: BLE001
            took = time.perf_counter() - start
            text = str(error)
            cause = text.rfind("Caused by")
            verdict = f"ERROR {type(error).__name__}: {text[:300]}"
            verdict += f" ... {text[cause:cause + 400]}" if cause > 0 else ""
            bad += 1
        print(f"{name:28s} {took:6.1f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
