"""Registry of named queries: key -> (spark plan builder, oracle SQL).

Every plan builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
The oracle text is the same computation in ANSI SQL over the driver's raw
tables; it is used only for checking, never by the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Plan) -> Plan:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


MODULES = (
    "fiscus.plans.econ",
    "fiscus.operators.ingest_queries",
    "fiscus.operators.quality",
    "fiscus.operators.evaluate",
    "fiscus.operators.scalar_queries",
    "fiscus.operators.corpus_queries",
    "fiscus.operators.clause_scan",
    "fiscus.operators.retrieval",
    "fiscus.operators.minhash",
    "fiscus.operators.sparse",
    "fiscus.operators.series",
    "fiscus.operators.voting",
    "fiscus.operators.execution",
    "fiscus.sources.round_trips",
    "fiscus.sources.layout",
)


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in MODULES:
        importlib.import_module(m)
