"""Benchmark: run every registered plan at $BENCH_SF_DIR on local[$BENCH_CPUS].

Like the reference (build the star schema once, then query it), the star
facts are first materialized -- timed as ``materialize_star`` -- into the
session's checkpoint folder, and every plan then reads them
(``fiscus.star.dir``).  BENCH_MATERIALIZE=0 runs the plans on the raw
tables instead.  Each plan is executed to completion with the ``noop`` sink
(all rows computed, nothing shipped to the driver).  Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import uuid  # noqa: E402

from fiscus.plans import registry  # noqa: E402
from fiscus.plans.star import STAR_DIR_CONF, Star  # noqa: E402
from fiscus.session import build_session, ensure_checkpoint_dir  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          app_name="fiscus-bench")
    registry.load_all()
    keys = only or sorted(registry.QUERIES)
    # warm-up: JVM, codegen cache and file listing, not timed
    registry.QUERIES["agg_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    materialize = os.environ.get("BENCH_MATERIALIZE", "1") != "0"
    if materialize:
        star_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/star-{uuid.uuid4().hex[:8]}"
        t0 = time.perf_counter()
        Star(spark, sf_dir).materialize(star_dir)
        times["materialize_star"] = round(time.perf_counter() - t0, 3)
        spark.conf.set(STAR_DIR_CONF, star_dir)
    for k in keys:
        t0 = time.perf_counter()
        try:
            registry.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[k] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 -- report, keep benchmarking the rest
            failed[k] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus, "n_queries": len(times),
           "mode": "materialized_star" if materialize else "raw_tables"}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
