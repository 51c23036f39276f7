"""Write PLANS.md: condensed executed plans of representative plans.

usage: python scripts/explain_plans.py [--sf DIR]

Each plan is run once (so AQE's final plan is shown) on the materialized
star (``fiscus.star.dir``) and only the lines that matter for scale are
kept: scans with pushed / partition filters, joins, exchanges, windows and
aggregates.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fiscus.plans import registry  # noqa: E402
from fiscus.plans.star import STAR_DIR_CONF, Star  # noqa: E402
from fiscus.session import build_session, ensure_checkpoint_dir  # noqa: E402

KEYS = ["proj_star_series", "conditional_pivot", "union_tagged", "coverage_multi_distinct",
        "left_join_popularity", "rank_avg_growth", "dq_orphans", "dq_report", "topk_cosine", "topk_per_group",
        "keyword_topn_fallback", "majority_vote", "result_equality", "tfidf_topk"]
KEEP = re.compile(r"(Scan|Join|Exchange|Window|HashAggregate|TakeOrdered|Expand|Generate|"
                  r"MapInPandas|PushedFilters|PartitionFilters|AQEShuffleRead|Union)")


def _field(line: str, name: str) -> str:
    m = re.search(name + r": (\[[^\]]*\])", line)
    return f" {name}: {m.group(1)[:160]}" if m else ""


def condense(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        if "FileScan" in line:
            head = line[:line.index("]") + 1] if "]" in line else line
            line = head + _field(line, "PartitionFilters") + _field(line, "PushedFilters")
        out.append(line[:260])
    return "\n".join(out)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    a = ap.parse_args()
    spark = build_session(extra={"spark.sql.maxMetadataStringLength": "400"})
    registry.load_all()
    star_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/star-{uuid.uuid4().hex[:8]}"
    Star(spark, a.sf).materialize(star_dir)
    spark.conf.set(STAR_DIR_CONF, star_dir)
    parts = ["# Executed plans (condensed)", "",
             f"Generated by `scripts/explain_plans.py` at `{os.path.basename(a.sf)}` on the materialized "
             "star (final AQE plans; scans, filters, joins, exchanges, windows and aggregates only).", ""]
    for k in KEYS:
        df = registry.QUERIES[k](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts += [f"## `{k}`", "", "```", condense(plan), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
