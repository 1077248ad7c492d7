"""Run queries and their SQL side by side: python -m tests.compare SF_DIR [NAME ...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES.split():
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return f"{type(value).__name__}:{value}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql: str) -> str | None:
    """None if equal, else the first difference."""
    result = connection.execute(sql)
    right_names, right = _rows([d[0] for d in result.description], result.fetchall())
    left_names, left = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        a, b = different[0]
        cells = [(n, x, y) for n, x, y in zip(left_names, a, b) if x != y]
        return f"{len(different)} of {len(left)} rows differ, first: {cells[:4]}"
    if not left:
        return "no rows on either side"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tidewire.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = fn(spark, sf_dir)
            if name in sql:
                problem = compare(frame, connection, sql[name])
            else:
                count = len(frame.collect())
                problem = None if count else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
