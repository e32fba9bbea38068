"""Run catalogue entries against their SQL in DuckDB and report differences.

    python tests/compare.py <sf_dir> [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0 if v else 0.0)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when rows, columns and kinds of types agree."""
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    theirs = _rows(names, res.fetchall())
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    kinds = {n: str(t) for n, t in ((c[0], c[1]) for c in con.execute(sql).description)}
    alike = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    out += [f"type of {n}: {t} / {kinds[n]}" for n, t in df.dtypes if alike.get(t, t) != kinds[n]]
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name, fn in entry.queries().items():
        if (only and name not in only) or (not only and name not in entry.oracle_sql()):
            continue
        t0 = time.time()
        try:
            if name in entry.oracle_sql():
                diff = compare(fn(spark, sf_dir), con, entry.oracle_sql()[name])
            else:
                print(name, fn(spark, sf_dir).count(), "rows")
                diff = []
        except Exception as e:  # report and go on
            diff = [f"{type(e).__name__}: {str(e)[:600]}"]
        failures += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t0:.1f}s {' | '.join(diff)[:900]}", flush=True)
    return failures


if __name__ == "__main__":
    raise SystemExit(main())
