"""Compare named queries with their SQL run by DuckDB on the same tables.

    python -m tests.oracle [SF_DIR] [NAME_PART ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(base: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return ("null", "")
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("null", "") if math.isnan(v) else ("float", round(v, 6) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return (type(v).__name__, v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(norm(x) for x in v))
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql: str) -> str:
    """Empty if equal, else what differs."""
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    right = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; e.g. {left[:1]} / {right[:1]}"
    for a, b in zip(left, right):
        if a != b:
            return f"spark {a} != duckdb {b}"
    return ""


def main(argv):
    base = argv[0] if argv and os.path.isdir(argv[0]) else "/root/testdata/sf0.01"
    parts = [a for a in argv if not os.path.isdir(a)]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from lumbre.session import build_session
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(base), e.oracle_sql(), 0
    names = [n for n in e.queries() if not parts or any(p in n for p in parts)]
    for n in names:
        start = time.time()
        try:
            df = e.queries()[n](spark, base)
            if n in oracles:
                why = compare(con, df, oracles[n])
            else:
                c = df.count()
                why = "" if c else "no rows"
        except Exception as x:  # noqa: BLE001 - reported below
            why = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(why)
        print(f"{'ok ' if not why else 'BAD'} {n:45s} {time.time() - start:6.2f}s {'' if n in oracles else '(rows only) '}{why[:900]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
