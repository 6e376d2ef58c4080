"""Compare registered queries with their SQL in DuckDB on the same tables.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def _rows(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same rows under the same names, else what differs."""
    names = df.columns
    ours = _rows(names, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    their_names = [d[0] for d in result.description]
    theirs = _rows(their_names, result.fetchall())
    if sorted(names) != sorted(their_names):
        return f"columns {sorted(names)} vs {sorted(their_names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for left, right in zip(ours, theirs, strict=True):
        if left != right:
            return f"{left} vs {right}"
    return "no rows at all" if not ours else None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from tripflow.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    oracles, bad = contract.oracle_sql(), 0
    for name, build in contract.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(build(spark, sf_dir), con, oracles[name])
            else:
                verdict = None if build(spark, sf_dir).collect() else "no rows at all"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{name:34s} {kind:5s} {time.time() - start:6.2f}s {verdict or 'ok'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
