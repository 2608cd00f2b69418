"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(row[i]) for i in order) for row in rows)


def compare(spark, con, name, build, sql, folder):
    df = build(spark, folder)
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    problems = []
    if sorted(df.columns) != sorted(columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    elif actual != expected:
        problems.append(f"rows {sum(actual.values())} vs {sum(expected.values())}")
        problems.append(f"only spark: {list((actual - expected).items())[:2]}")
        problems.append(f"only sql:   {list((expected - actual).items())[:2]}")
    return sum(actual.values()), problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from dossier.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    wanted = sys.argv[2:]
    con = connect(folder)
    oracles = oracle_sql()
    bad = 0
    for name, build in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                n, problems = compare(spark, con, name, build, oracles[name], folder)
            else:
                n, problems = len(build(spark, folder).collect()), []
        except Exception as error:  # report and go on
            n, problems = -1, [str(error)[:1500]]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name:34s} rows={n:<8d} {time.time() - start:6.2f}s {'' if name in oracles else '(rows only)'}", flush=True)
        for problem in problems:
            print("     ", problem[:1800])
    print("bad:", bad)
