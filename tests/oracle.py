"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    order = [theirs_names.index(c) for c in names]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"{len(ours)} rows vs {len(theirs)}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    spark_kinds = dict(df.dtypes)
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    odd = [(c, spark_kinds[c], kinds[c]) for c in names if alike.get(spark_kinds[c]) not in (kinds[c], "VARCHAR")]
    odd = [o for o in odd if not (o[1] == "string")]
    return f"types {odd}" if odd else None


def main(argv: list[str]) -> None:
    import workload

    sf_dir = argv[0]
    wanted = argv[1:] or list(workload.QUERIES)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            if name in workload.ORACLES:
                problem = compare(spark, con, name, workload.QUERIES[name], workload.ORACLES[name], sf_dir)
            else:
                rows = workload.QUERIES[name](spark, sf_dir).collect()
                problem = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} equal", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
