"""Run every query with a DuckDB twin and compare rows: python -m tests.oracle [sf_dir] [name ...]"""

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def kind(t):
    t = str(t).lower()
    return "int" if t in ("tinyint", "smallint", "integer", "bigint", "hugeint", "int", "short", "long") else "float" if t in ("double", "float") or t.startswith("decimal") else "string" if t in ("varchar", "string") else "bool" if t.startswith("bool") else t


def compare(spark, con, sf, f, sql):
    """None if they agree, else what differs."""
    got = f(spark, sf)
    rel = con.sql(sql)
    a, b = rows(got.columns, got.collect()), rows(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    ka, kb = {c: t for c, t in got.dtypes}, {c: str(t) for c, t in zip(rel.columns, rel.types)}
    exact = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    odd = [(c, ka[c], kb[c]) for c in a[0] if exact.get(ka[c], ka[c]) != kb[c].lower()]
    if any(kind(x) != kind(y) for _, x, y in odd):
        return f"types {odd}"
    if a[1] != b[1]:
        here, there = set(a[1]), set(b[1])
        only = [x for x in a[1] if x not in there][:2], [x for x in b[1] if x not in here][:2]
        return f"{len(a[1])} and {len(b[1])} rows; only here {only[0]}; only there {only[1]}"
    return f"types {odd}" if odd else None if a[1] else "no rows"


def main():
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, twins = connect(sf), e.oracle_sql()
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if not sys.argv[2:] and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            bad = compare(spark, con, sf, f, twins[name]) if name in twins else f"-- {f(spark, sf).count()} rows" and None
        except Exception as x:
            bad = "ERROR " + (str(x).split("JVM stacktrace")[0][:600] if not os.environ.get("TRACE") else traceback.format_exc())
        print(f"{'ok ' if not bad else 'BAD'} {name} {time.time() - t:.1f}s {bad or ''}", flush=True)


if __name__ == "__main__":
    main()
