"""Run registered queries beside their DuckDB SQL and compare the full results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float, Decimal)):
        x = float(v)
        return ("n", "nan" if math.isnan(x) else round(x, 5) + 0.0)
    if isinstance(v, datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, date):
        return ("d", v.isoformat())
    return ("s", str(v))


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = sorted(tuple(_plain(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], out


_FAMILY = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool",
           "timestamp": "ts", "date": "date",
           "BIGINT": "int", "INTEGER": "int", "HUGEINT": "int128", "DOUBLE": "float",
           "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date",
           "TIMESTAMP WITH TIME ZONE": "ts"}


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> list[str]:
    """Problems found; an empty list means equal."""
    df = query(spark, sf_dir)
    columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_columns, want = canonical([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if columns != want_columns:
        return [f"columns {columns} != {want_columns}"]
    for field in df.schema.fields:
        a = _FAMILY.get(field.dataType.simpleString(), field.dataType.simpleString())
        b = _FAMILY.get(types[field.name], types[field.name])
        if a != b:
            problems.append(f"type of {field.name}: {a} != {b}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        problems.append(f"values differ\n   spark only {extra}\n   duck only  {missing}"[:1600])
    if not got:
        problems.append("no rows")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from plumbline.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("oracle-check", 8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    names = [n for n in queries if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                n = queries[name](spark, sf_dir).count()
                problems = [] if n else ["no rows"]
        except Exception as exc:
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s", *problems, flush=True)
    print(f"{len(names)} queries, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
