"""Run queries against their SQL counterparts: python tests/compare.py [folder] [names...]"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def sql_connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(series: pd.Series) -> str:
    k = series.dtype.kind
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(k, "text")


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA
                  else v for v in row)
            for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both frames hold exactly the same rows, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (kind(got[c]), kind(want[c])) for c in got.columns
             if len(got) and kind(got[c]) != kind(want[c])}
    if kinds:
        return f"types {kinds}"
    for a, b in zip(canonical(got), canonical(want)):
        if any(str(x) != str(y) for x, y in zip(a, b)):
            return f"row {a} != {b}"
    return None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as entry
    from tallyspark.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = sql_connection(folder)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"rows-only {name} {len(got)} {took:.1f}s", flush=True)
                continue
            why = difference(got, con.execute(oracle[name]).df())
        except Exception as error:                            # report and go on
            why, took, got = f"{type(error).__name__}: {str(error)[:700]}", time.time() - start, []
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {len(got)} {took:.1f}s {why or ''}",
              flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
