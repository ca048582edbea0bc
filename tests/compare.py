"""Run registered queries on Spark and their oracle SQL on DuckDB and compare."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagegrain.plans.bindings import TABLES  # noqa: E402

SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
}


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagegrain-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def compare(spark, con, fn, sql, sf_dir):
    """None if equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    df = df.select(*cols)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}"
    types = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    st = {f.name: f.dataType.simpleString() for f in df.schema}
    bad = {c: (st[c], types[c]) for c in cols if SPARK_TYPES.get(st[c], st[c]) != types[c]}
    if bad:
        return f"types {bad}"
    order = ", ".join(f'"{c}"' for c in cols)
    want = con.sql(f"SELECT {order} FROM ({sql}) q").fetchall()
    a = sorted(tuple(_norm(v) for v in r) for r in got)
    b = sorted(tuple(_norm(v) for v in r) for r in want)
    if a == b:
        return None if a else "both empty"
    sa, sb = set(a), set(b)
    return (
        f"rows {len(a)} vs {len(b)}; cols {cols}; only spark {str(sorted(sa - sb)[:2])[:600]}; "
        f"only duckdb {str(sorted(sb - sa)[:2])[:600]}"
    )


def main(argv):
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    qs, os_ = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    fails = 0
    for n in names:
        t = time.time()
        try:
            r = compare(spark, con, qs[n], os_.get(n), sf_dir)
        except Exception as e:  # report and go on to the next query
            r = f"error {type(e).__name__}: {str(e)[:900]}"
        fails += r is not None
        print(f"{'ok ' if r is None else 'BAD'} {n} {time.time() - t:.1f}s"
              f"{'' if n in os_ else ' (no oracle)'} {r or ''}", flush=True)
    print(f"{len(names)} queries, {fails} bad")
    return fails


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
