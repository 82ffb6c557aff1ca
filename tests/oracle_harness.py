"""Run a registered Spark job and its DuckDB SQL on the same parquet tables
and compare row count, column names and (order-insensitive) values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


def compare(spark, con, name: str, job, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = job(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "spark_rows": len(srows), "duck_rows": len(drows), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2), "cols_match": sorted(scols) == sorted(dcols)}
    if not res["cols_match"]:
        res["spark_cols"], res["duck_cols"] = scols, dcols
        res["match"] = False
        return res
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    sn = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=_key)
    dn = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=_key)
    res["match"] = sn == dn
    if not res["match"]:
        sset, dset = set(map(repr, sn)), set(map(repr, dn))
        res["only_spark"] = [x[:300] for x in list(sset - dset)[:3]]
        res["only_duck"] = [x[:300] for x in list(dset - sset)[:3]]
    return res


if __name__ == "__main__":
    from parlance.session import get_session
    import __spark_entry__ as E

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = get_session("local[8]", scan_partitions=8, driver_memory="12g")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    for n in names or sorted(sqls):
        try:
            print(compare(spark, con, n, qs[n], sqls[n], sf_dir), flush=True)
        except Exception as e:  # noqa: BLE001
            print({"name": n, "error": repr(e)[:1500]}, flush=True)
