"""Run queries beside their SQL and compare whole results.

Usage: python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def normal(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def plan(df) -> str:
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]


# pairing all rows with all rows, or Python row at a time
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def check(spark, con, name: str, fn, statement: str, sf_dir: str) -> str | None:
    """None where both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    for node in BAD_NODES:
        if node in plan(df):
            return f"the plan holds {node}"
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(statement)
    theirs = normal([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    if ours[1] != theirs[1]:
        bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from halocast.session import build_session

    spark, con = build_session(), connect(sf_dir)
    queries, statements = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in statements:
                wrong = check(spark, con, name, fn, statements[name], sf_dir)
            else:
                wrong = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        failed += wrong is not None
        mark = "ok  " if wrong is None else "FAIL"
        kind = "" if name in statements else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{kind} {wrong or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
