"""Run registered queries beside their SQL: python tests/check_oracle.py [-d folder] [name ...]"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark_df, con, sql: str) -> list[str]:
    """Differences in names, counts and exact values; empty when the two results are equal."""
    columns = sorted(spark_df.columns)
    got = [tuple(r) for r in spark_df.select(*[f"`{c}`" for c in columns]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        only = sorted(set(names) ^ set(columns))
        return [f"columns differ: {only[:10]}"]
    place = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in place) for r in cur.fetchall()]
    if len(got) != len(want):
        return [f"rows: {len(got)} spark, {len(want)} sql"]
    out = []
    bad: dict[str, int] = {}
    for a, b in zip(normal(got), normal(want)):
        for c, x, y in zip(columns, a, b):
            if x != y or type(x) is not type(y):
                bad[c] = bad.get(c, 0) + 1
                if len(out) < 4:
                    out.append(f"{c}: {x!r} spark, {y!r} sql")
    if bad:
        out.append(f"cells that differ: {dict(list(bad.items())[:12])}")
    return out


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    queries, oracle, spark, con = entry.queries(), entry.oracle_sql(), session(), oracle_connection(args.d)
    failed = []
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.d)
            if name in oracle:
                diff = differences(df, con, oracle[name])
                state = "ok" if not diff else "DIFF " + " | ".join(diff)
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            state = f"ERROR {type(e).__name__} {str(e)[:600]}"
        if not state.startswith(("ok", "rows")):
            failed.append(name)
        print(f"{name:24s} {time.time() - start:6.1f}s {state}", flush=True)
    print("failed:", failed)
