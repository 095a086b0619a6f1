"""Run registered queries against their SQL on DuckDB and compare whole results.

    python tests/check_queries.py [scale] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    rows = sorted((tuple(r) for r in df.itertuples(index=False)), key=repr)
    return pd.DataFrame(rows, columns=sorted(df.columns))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = normal(got), normal(want)
    if not a.equals(b):
        bad = [i for i in range(len(a)) if tuple(a.iloc[i]) != tuple(b.iloc[i])]
        if bad:
            return f"values differ in {len(bad)} rows: {tuple(a.iloc[bad[0]])} / {tuple(b.iloc[bad[0]])}"
    loose = {k: (x, y) for (k, x), y in zip(kinds(got).items(), kinds(want).values(), strict=True) if x != y}
    loose = {k: v for k, v in loose.items() if set(v) != {"object", "str"} and "datetime" not in v[0]}
    return f"types {loose}" if loose else ""


def check(spark, sf_dir: str, names: list[str] | None = None) -> dict[str, str]:
    from __spark_entry__ import oracle_sql, queries

    con, oracles, problems = connect(sf_dir), oracle_sql(), {}
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took, start = time.time() - start, time.time()
            problem = compare(got, con.execute(oracles[name]).df()) if name in oracles else ("" if len(got) else "no rows")
        except Exception as exc:  # report every query, not the first failure
            took, problem, got = time.time() - start, f"{type(exc).__name__}: {str(exc)[:1500]}", []
        print(f"{'ok ' if not problem else 'BAD'} {name:28s} rows={len(got):7d} spark={took:6.2f}s sql={time.time() - start:5.2f}s "
              f"{'' if name in oracles else '(no sql) '}{problem}", flush=True)
        if problem:
            problems[name] = problem
    return problems


if __name__ == "__main__":
    from terrane.session import build_session

    scale, wanted = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), sys.argv[2:]
    session = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    failed = check(session, f"/root/testdata/sf{scale}", wanted or None)
    print("all equal" if not failed else f"{len(failed)} differ: {sorted(failed)}")
    sys.exit(1 if failed else 0)
