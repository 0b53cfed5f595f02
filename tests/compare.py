"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def difference(df, con, sql):
    """None if a query's rows equal the SQL's, else what differs."""
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    b = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    if a != b:
        only = [x for x in a if x not in set(b)][:2] if len(a) < 20000 else a[:2]
        other = [x for x in b if x not in set(a)][:2] if len(b) < 20000 else b[:2]
        return f"{len(a)} and {len(b)} rows; {order}; only here {only}; only there {other}"
    return None


def main(sf, names):
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls, bad = connect(sf), e.queries(), e.oracle_sql(), 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            found = difference(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
            if found and name in sqls:
                bad += 1
            if found:
                print(name, round(time.time() - t, 1), found[:700], flush=True)
        except Exception:
            bad += 1
            print(name, "FAILED", "\n".join(x for x in traceback.format_exc().splitlines() if "/py4j/" not in x)[-900:], flush=True)
    print("differ:", bad, "of", len(names or queries))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
