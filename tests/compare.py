"""Run registered queries against their SQL twins: `python tests/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import math
import signal
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, Decimal):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = sorted(tuple(_cell(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], cells


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = canonical(columns, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows vs {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}"
    return None if got[1] else "no rows"


def _too_slow(*_):
    raise TimeoutError("query took over three minutes")


def main():
    from __spark_entry__ import oracle_sql, queries
    from callscope.session import build_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
        },
    )
    con = duck(sf_dir)
    sqls = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        t = time.time()
        signal.signal(signal.SIGALRM, _too_slow)
        signal.alarm(180)
        try:
            if name in sqls:
                problem = compare(spark, con, name, query, sqls[name], sf_dir)
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                problem, note = None, f"rows only: {len(query(spark, sf_dir).collect())}"
        except Exception as error:  # noqa: BLE001
            problem, note = error, f"ERROR {type(error).__name__}: {str(error)[:700]}"
        finally:
            signal.alarm(0)
        failed += problem is not None
        print(f"{name:28s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
