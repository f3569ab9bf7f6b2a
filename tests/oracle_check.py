"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [sf] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle_connection(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, bool) else (True, "b", v) for v in r))


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = sorted_rows(spark_df.columns, got), sorted_rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        shorten = lambda r: tuple(str(v)[:160] for v in r)
        return f"{len(bad)} rows differ, e.g.\n  spark  {shorten(bad[0][0])}\n  oracle {shorten(bad[0][1])}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from weir.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    # Results must not depend on the session's time zone.
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("CHECK_TZ", "UTC"))
    con = oracle_connection(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(queries[name](spark, folder), con, oracle[name])
            else:
                problem = None if queries[name](spark, folder).count() >= 0 else "?"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s "
              f"{'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", failed)
