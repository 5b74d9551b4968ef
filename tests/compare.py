"""Runs every registered query against its SQL and reports exact differences.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if Path(path).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("-0.0" if str(value) == "-0.0" else value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree row by row, else a short account."""
    got_columns = spark_df.columns
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    want = _rows(want_columns, result.fetchall())
    got = _rows(got_columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    apart = [(g, w) for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]
    if apart:
        return f"{len(apart)} of {len(got)} rows differ, e.g. {apart[0][0]} != {apart[0][1]}"
    return None


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as spark_entry
    from ebbline.session import local_session

    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    con = connect(folder)
    queries, oracle = spark_entry.queries(), spark_entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            report = difference(df, con, oracle[name]) if name in oracle else "no SQL"
        except Exception as error:  # noqa: BLE001
            report = f"{type(error).__name__}: {str(error)[:600]}"
        failed += report is not None
        print(f"{'ok ' if report is None else 'BAD'} {name} {time.time() - start:.1f}s {report or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(1 if main(args[0] if args else "/root/testdata/sf0.01", args[1:]) else 0)
