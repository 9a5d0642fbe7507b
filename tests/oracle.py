"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if v is None else v for v in t))
    return names, body


def compare(df, con, sql: str) -> str:
    """Empty text if both results are equal, else what differs first."""
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    right = canonical([d[0] for d in rel.description], rel.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(wrong)} of {len(left[1])} rows differ, first {wrong[0]}" if wrong else ""


def main(sf: str, wanted: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from panelmill.session import local_session

    spark, con = local_session(cpus=8), connect(DATA / sf)
    spark.sparkContext.setLogLevel("OFF")
    sql = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(fn(spark, str(DATA / sf)), con, sql[name])
                n = "="
            else:
                problem, n = "", len(fn(spark, str(DATA / sf)).collect())
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", "!"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} [{n}] {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
