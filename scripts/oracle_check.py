"""Run registered Spark plans and their DuckDB oracle side by side.

usage: python scripts/oracle_check.py [--sf DIR] [key ...]

Compares column names, row count and an order-insensitive multiset of rows
(floats rounded to 6 places).  Exit code 1 when any key differs.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fiscus.plans import registry  # noqa: E402
from fiscus.session import build_session  # noqa: E402
from fiscus.sources.tables import TABLE_NAMES  # noqa: E402


EXACT_FLOATS = os.environ.get("ORACLE_EXACT_FLOATS") == "1"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT_FLOATS else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


STRICT = os.environ.get("ORACLE_STRICT_TYPES") == "1"
_EXACT = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint",
          "double": "double", "float": "float", "string": "varchar", "boolean": "boolean",
          "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def spark_kind(t: str) -> str:
    t = t.lower()
    if STRICT:
        if t.startswith("array<"):
            return spark_kind(t[6:-1]) + "[]"
        return _EXACT.get(t, t)
    if t in ("int", "bigint", "smallint", "tinyint"):
        return "int"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float"
    if t.startswith("array"):
        return "list"
    return {"string": "str", "boolean": "bool"}.get(t, t)


def duck_kind(t: str) -> str:
    if STRICT:
        return str(t).lower()
    t = str(t).upper()
    if t in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT", "HUGEINT", "UBIGINT", "UINTEGER"):
        return "int"
    if t in ("DOUBLE", "FLOAT") or t.startswith("DECIMAL"):
        return "float"
    if t.endswith("[]"):
        return "list"
    return {"VARCHAR": "str", "BOOLEAN": "bool"}.get(t, t.lower())


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    registry.load_all()
    keys = a.keys or sorted(registry.QUERIES)
    extra = {}
    spark = build_session(shuffle_partitions=int(os.environ.get("ORACLE_SHUFFLE_PARTITIONS", "8")),
                          extra=extra)
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = registry.QUERIES[k](spark, a.sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            skinds = dict((n, spark_kind(t)) for n, t in df.dtypes)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLE.get(k)
        if sql is None:
            print(f"ROWS {k}: {len(srows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            okinds = {d[0]: duck_kind(d[1]) for d in cur.description}
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = canon(scols, srows)
        c2, r2 = canon(ocols, orows)
        if c1 != c2:
            print(f"FAIL {k}: columns spark={c1} oracle={c2}")
            bad += 1
        elif skinds != okinds:
            print(f"FAIL {k}: types spark={skinds} oracle={okinds}")
            bad += 1
        elif r1 != r2:
            diff1 = [r for r in r1 if r not in r2][:3]
            diff2 = [r for r in r2 if r not in r1][:3]
            print(f"FAIL {k}: rows spark={len(r1)} oracle={len(r2)} only_spark={diff1} only_oracle={diff2}")
            bad += 1
        else:
            print(f"OK   {k}: {len(r1)} rows {ts:.2f}s")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
