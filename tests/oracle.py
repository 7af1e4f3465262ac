"""Runs registered queries beside their SQL. Usage: oracle.py SF_DIR [name part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time


def connect(sf_dir: str):
    import duckdb

    from leadloom.sources.views import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both engines agree, else a short description."""
    from leadloom.plans import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if mine[1] else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = normal(columns, cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = sorted(set(mine[1]) - set(theirs[1])), sorted(set(theirs[1]) - set(mine[1]))
        return f"{len(mine[1])} / {len(theirs[1])} rows; spark only {a[:2]}; sql only {b[:2]}"
    return None if mine[1] else "no rows"


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from pyspark.sql import SparkSession

    from leadloom.plans import oracle_sql, queries

    sf_dir, parts = sys.argv[1], sys.argv[2:]
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
    for name in queries():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:700]}"
        note = "" if name in oracle_sql() else " (rows only)"
        print(f"{name}: {'ok' if not found else found}{note} {time.time() - start:.1f}s", flush=True)
        bad += bool(found)
    print("failures:", bad)


if __name__ == "__main__":
    main()
