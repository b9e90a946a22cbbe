"""Compare queries with their SQL: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """``None`` when equal, else what differs."""
    df = queries()[name](spark, sf_dir)
    sql = oracle_sql().get(name)
    names = sorted(df.columns)
    got = sorted(tuple(cell(row[c]) for c in names) for row in df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    sql_names = [d[0] for d in rel.description]
    if sorted(sql_names) != names:
        return f"columns {names} != {sorted(sql_names)}"
    types = {d[0]: str(d[1]) for d in rel.description}
    off = [(c, t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]]
    if off:
        return f"types differ: {off}"
    order = [sql_names.index(c) for c in names]
    want = sorted(tuple(cell(row[i]) for i in order) for row in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first: {names} {bad[0]}" if bad else None


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:] or list(queries())
    spark, con, failed = session(), connect(sf_dir), 0
    for q in wanted:
        started = time.perf_counter()
        try:
            problem = compare(spark, con, sf_dir, q)
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        kind = "sql " if q in oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.perf_counter() - started:6.2f}s {q} {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} ok")
    sys.exit(failed > 0)
