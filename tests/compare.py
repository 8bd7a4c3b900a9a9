"""Run registered queries beside their DuckDB twins: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import datetime
import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def shape(table) -> tuple[list[str], list[str]]:
    """Sorted column names and the sorted digests of all rows."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [hashlib.md5("\x1f".join(map(cell, row)).encode()).hexdigest() for row in zip(*columns)]
    return names, sorted(rows)


def arrow(result):
    for name in ("fetch_arrow_table", "to_arrow_table", "arrow"):
        if hasattr(result, name):
            out = getattr(result, name)()
            return out.read_all() if hasattr(out, "read_all") else out
    raise RuntimeError("no Arrow result")


def differences(spark_table, duck_table, show: int = 2) -> str:
    names, left = shape(spark_table)
    other, right = shape(duck_table)
    if names != other:
        return f"columns {names} / {other}"
    kinds = [(n, str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type)) for n in names]
    kinds = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    note = f" types {kinds}" if kinds else ""
    if left != right:
        return f"rows {len(left)} / {len(right)}, {len(set(left) ^ set(right))} digests differ{note}"
    return note.strip()


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pliego.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            got = query(spark, sf_dir).toArrow()
            middle = time.time()
            result = "no oracle"
            if name in sql:
                result = differences(got, arrow(con.execute(sql[name]))) or "ok"
            print(f"{name:28} {got.num_rows:7} rows  spark {middle - begin:6.2f}s  duckdb {time.time() - middle:6.2f}s  {result}", flush=True)
        except Exception as error:  # noqa: BLE001 - a report of every query is wanted
            result = f"{type(error).__name__}: {str(error)[:1500]}"
            print(f"{name:28} FAILED {result}", flush=True)
        if result not in ("ok", "no oracle"):
            bad.append(name)
    print("differ:", bad or "none")


if __name__ == "__main__":
    main()
