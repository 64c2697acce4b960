"""Run every query against its DuckDB counterpart: ``python -m verification.check [sf_dir] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from loanpanel.session import build_session
from verification.catalog import ORACLES, QUERIES
from verification.inputs import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normalise(t):
    pdf = t.to_pandas(types_mapper=pd.ArrowDtype)
    pdf = pdf[sorted(pdf.columns)]
    key = pdf.astype(str)
    return key.sort_values(list(key.columns)).reset_index(drop=True)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int, float]:
    start = time.time()
    got = QUERIES[name](spark, sf_dir).toArrow()
    spent = time.time() - start
    if name not in ORACLES:
        return "rows-only", got.num_rows, spent
    want = con.sql(ORACLES[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"COLUMNS {sorted(set(got.column_names) ^ set(want.column_names))}", got.num_rows, spent
    types = [f"{c}:{got.schema.field(c).type}/{want.schema.field(c).type}" for c in got.column_names
             if got.schema.field(c).type != want.schema.field(c).type]
    if got.num_rows != want.num_rows:
        return f"ROWS {got.num_rows} vs {want.num_rows}", got.num_rows, spent
    a, b = normalise(got), normalise(want)
    if not types and not a.equals(b):
        diff = a.ne(b).any(axis=1)
        return (f"VALUES differ in {int(diff.sum())} rows, columns {list(a.columns[a.ne(b).any()])}\n"
                f"{a[diff].head(3).to_string()}\n{b[diff].head(3).to_string()}"), got.num_rows, spent
    return ("TYPES " + ", ".join(types) if types else "match"), got.num_rows, spent


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("verification", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in sys.argv[2:] or QUERIES:
        try:
            verdict, rows, spent = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            verdict, rows, spent = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += verdict not in ("match", "rows-only")
        print(f"{name:24s} {rows:8d} rows {spent:6.2f}s  {verdict}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
