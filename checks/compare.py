"""Run registered queries beside their SQL and report differences.

``python -m checks.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import oracle
from checks.queries import QUERIES
from nearfield.runtime import session


def oracle_rows(con, text):
    result = con.execute(text)
    names = [c[0] for c in result.description]
    return names, result.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6f}".replace("-0.000000", "0.000000")
        return repr(x) if not isinstance(x, bool) else str(x)

    return sorted(names), sorted(tuple(value(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def check(spark, con, name, sf_dir, texts):
    start = time.monotonic()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.monotonic() - start
    if name not in texts:
        return f"rows only ({len(rows)})", took, 0.0
    start = time.monotonic()
    wanted_names, wanted = normal(*oracle_rows(con, texts[name]))
    sql_took = time.monotonic() - start
    names, mine = normal(df.columns, rows)
    if names != wanted_names:
        return f"COLUMNS {names} != {wanted_names}", took, sql_took
    if mine != wanted:
        extra = [r for r in mine if r not in set(wanted)][:3]
        lacking = [r for r in wanted if r not in set(mine)][:3]
        return f"DIFFERS {len(mine)} rows, SQL {len(wanted)}: {extra} / {lacking}", took, sql_took
    return f"equal ({len(mine)})", took, sql_took


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(master="local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                          "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("OFF")
    con, texts = connect(sf_dir), oracle()
    for name in sys.argv[2:] or QUERIES:
        try:
            verdict, took, sql_took = check(spark, con, name, sf_dir, texts)
        except Exception as error:
            verdict, took, sql_took = f"FAILED {type(error).__name__}: {str(error)[:300]}", 0, 0
        print(f"{name:28s} {took:6.1f}s sql {sql_took:5.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
