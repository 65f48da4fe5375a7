"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return ("i", value)
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    sql_seconds = time.time() - start
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    else:
        a, b = rows_of(df.columns, got), rows_of(names, want)
        if a != b:
            only_a = [x for x in a if x not in set(b)][:3]
            only_b = [x for x in b if x not in set(a)][:3]
            problems.append(f"{len(a)} vs {len(b)} rows; spark only {str(only_a)[:600]}; sql only {str(only_b)[:600]}")
    return problems, len(got), spark_seconds, sql_seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            if name in sqls:
                problems, n, a, b = compare(spark, con, sf_dir, query, sqls[name])
            else:
                start = time.time()
                n, problems, b = len(query(spark, sf_dir).collect()), [], 0.0
                a = time.time() - start
            print(f"{'ok ' if not problems else 'BAD'} {name:22s} rows={n:6d} spark={a:5.2f}s sql={b:5.2f}s {'' if name in sqls else '(rows only)'} {'; '.join(problems)}", flush=True)
        except Exception as error:
            print(f"ERR {name}: {type(error).__name__} {str(error)[:700]}", flush=True)
