"""Run registered queries on Spark and on DuckDB and compare the rows.

    python -m tests.oracle [--sf 0.01] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

DATA = "/root/testdata"


def session(cpus: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("proofmill")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true").getOrCreate())


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", None if math.isnan(v) else round(v, 6))
    if isinstance(v, str):
        return ("s", v)
    return (type(v).__name__, str(v))


def compare(df, con, sql) -> tuple[bool, str]:
    cols = sorted(df.columns)
    mine = [tuple(canon(r[c]) for c in cols) for r in df.select(*cols).collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    took = f"duck {time.time() - t1:.1f}s"
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    theirs = [tuple(canon(r[i]) for i in idx) for r in rows]
    a, b = Counter(mine), Counter(theirs)
    if a == b:
        return True, f"{len(mine)} rows {took}"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return False, (f"rows {len(mine)} vs {len(theirs)}; differ {len(only_a)}/{len(only_b)}\n   cols {cols}\n   spark {sorted(only_a, key=str)[:3]}"
                   f"\n   duck  {sorted(only_b, key=str)[:3]}")


def main(argv: list[str]) -> int:
    from proofmill.plans.registry import oracle_queries, spark_queries

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    folder = f"{DATA}/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = spark_queries(), oracle_queries()
    keys = argv or list(queries)
    con = duck(folder)
    bad = 0
    for key in keys:
        t = time.time()
        try:
            df = queries[key](spark, folder)
            if key in oracles:
                ok, note = compare(df, con, oracles[key])
            else:
                ok, note = True, f"rows-only {len(df.collect())}"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(exc))[:900]
        bad += not ok
        print(("ok  " if ok else "FAIL"), key, f"{time.time() - t:.1f}s", note, flush=True)
    print("failures:", bad, "of", len(keys))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
