"""Side-by-side run of the registered queries and their SQL (python tests/check.py [names])."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, sf_dir, query, text):
    df = query(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns differ: {set(sc) ^ set(dc)}"
    if len(sr) != len(dr):
        return f"rows differ: spark {len(sr)} sql {len(dr)}"
    for a, b in zip(sr, dr):
        if [str(x) for x in a] != [str(x) for x in b]:
            bad = [(c, x, y) for c, x, y in zip(sc, a, b) if str(x) != str(y)]
            return f"values differ: {bad[:4]} in {a[:6]}"
    return None if sr else "EMPTY"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        t = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, sf_dir, queries[name], oracle[name])
            else:
                n = queries[name](spark, sf_dir).count()
                problem = None if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - t:6.2f}s {name} {problem or ''}",
              flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
