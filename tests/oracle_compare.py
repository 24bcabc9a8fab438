"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's check: column names (sorted), row count and an
order-insensitive hash of the values (doubles rounded).
Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from lookout.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except Exception:
        pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def digest(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.to_dict("records"))
    return cols, len(rows), hashlib.sha1("\n".join(rows).encode()).hexdigest(), rows


def compare(spark, con, name, entry, sf_dir, verbose=True):
    t0 = time.time()
    sdf = entry.build(spark, sf_dir).toPandas()
    t1 = time.time()
    if entry.sql is None:
        return {"name": name, "ok": None, "rows": len(sdf), "spark_s": t1 - t0}
    ddf = con.sql(entry.sql).df()
    sc, sn, sh, sr = digest(sdf)
    dc, dn, dh, dr = digest(ddf)
    ok = sc == dc and sn == dn and sh == dh
    res = {"name": name, "ok": ok, "rows": sn, "oracle_rows": dn, "spark_s": round(t1 - t0, 2)}
    if not ok and verbose:
        if sc != dc:
            res["cols"] = (sc, dc)
        else:
            a, b = set(sr), set(dr)
            res["only_spark"] = sorted(a - b)[:3]
            res["only_oracle"] = sorted(b - a)[:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from lookout.session import get_spark
    from lookout.plans.catalog import load_all
    spark = get_spark("local[8]", shuffle_partitions=8)
    reg = load_all()
    con = duck(sf_dir)
    bad = 0
    for name, entry in reg.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            r = compare(spark, con, name, entry, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
