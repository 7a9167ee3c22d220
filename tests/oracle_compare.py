"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]

The comparison mirrors the driver's: columns sorted by name, rows compared as
an order-insensitive multiset of normalised values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


_SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                  "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                  "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT", "smallint": "SMALLINT"}


def spark_type_as_duck(t: str) -> str:
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    if t.startswith("array<"):
        return spark_type_as_duck(t[6:-1]) + "[]"
    return _SPARK_TO_DUCK.get(t, t.upper())


def compare_one(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    scols = sdf.columns
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sr = canonical(scols, srows)
    dc, dr = canonical(dcols, drows)
    ok = sc == dc and sr == dr
    detail = ""
    stypes = {f.name: spark_type_as_duck(f.dataType.simpleString()) for f in sdf.schema.fields}
    dtypes = {d[0]: str(d[1]).replace(" ", "") for d in res.description}
    type_diff = {c: (stypes.get(c), dtypes.get(c)) for c in stypes
                 if c in dtypes and stypes[c] != dtypes[c].upper()}
    if type_diff:
        detail += f" [type differences: {type_diff}]"
    if sc != dc:
        detail += f"columns differ: spark={sc} duck={dc}"
    elif len(sr) != len(dr):
        detail += f"row count spark={len(sr)} duck={len(dr)}"
    elif sr != dr:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        detail += f"values differ: spark-only={diff_s} duck-only={diff_d}"
    return ok, len(sr), t_spark, detail


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from ledgerlens.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = 0
    for name in names or sorted(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS-ONLY {name}: {n} rows ({time.time() - t0:.2f}s)")
            continue
        try:
            ok, n, t, detail = compare_one(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # report and continue
            ok, n, t, detail = False, -1, 0.0, f"error: {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {n} rows ({t:.2f}s) {detail}")
    print(f"{len(names or qs) - failed} ok / {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
