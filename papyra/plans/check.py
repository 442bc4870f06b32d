"""Compare a registered query with its DuckDB oracle (row count, column names,
order-insensitive values). Used by the tests and during development:

    python -m papyra.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import numpy as np

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "isoformat"):
        if isinstance(v, dt.datetime) or hasattr(v, "to_pydatetime"):
            try:
                if v != v:  # NaT
                    return None
            except Exception:
                pass
        return v.isoformat()
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, name: str, builder, sql, con=None) -> dict:
    t0 = time.time()
    sp = builder(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sp), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["oracle"] = "rows-only"
        return res
    con = con or duck_connect(sf_dir)
    dk = con.sql(sql).df()
    res["oracle_rows"] = len(dk)
    scols, srows = rows_of(sp)
    dcols, drows = rows_of(dk)
    kinds = lambda df: {c: str(df[c].dtype) for c in df.columns}
    sk, dkinds = kinds(sp), kinds(dk)
    res["dtype_diffs"] = {c: (sk[c], dkinds.get(c)) for c in sk
                          if c in dkinds and sk[c] != dkinds[c] and "object" not in (sk[c], dkinds[c])}
    res["schema_match"] = scols == dcols
    res["rows_match"] = len(srows) == len(drows)
    res["values_match"] = res["schema_match"] and srows == drows
    if not res["values_match"]:
        res["spark_cols"], res["oracle_cols"] = scols, dcols
        diff_s = [r for r in srows if r not in set(drows)][:3]
        diff_d = [r for r in drows if r not in set(srows)][:3]
        res["spark_only"], res["oracle_only"] = diff_s, diff_d
    return res


def main(argv):
    from papyra.session import local_session
    from papyra.plans.catalog import load_all
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    reg = load_all()
    spark = local_session(8)
    con = duck_connect(sf_dir)
    bad = 0
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, sf_dir, name, fn, sql, con)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:600]}
        ok = r.get("values_match", r.get("oracle") == "rows-only" and "error" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} failing", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
