"""Run queries and their SQL twins side by side: ``python -m duoscreen.catalog.check <sf_dir> [name ...]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if both sides agree, else what differs."""
    from duoscreen.catalog import QUERIES

    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    got = df.collect()
    if q.sql is None:
        return None if got else "no rows"
    cur = con.execute(q.sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None if a else "both empty"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} rows vs {len(b)}; first differences {diff}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from duoscreen.catalog import QUERIES

    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        sql = "" if QUERIES[name].sql else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}{sql} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
