"""fiscus: Spark-native economic-statistics and query-corpus engine.

Layers (see README):
  sources/    readers and writers (parquet tables, CSV/JSON/JSONL/text files)
  plans/      the star-schema analog and the analytic query plans
  operators/  ingest, data quality, corpus processing, retrieval, voting, evaluation
  functions/  reusable Column -> Column expressions
  streaming/  incremental file ingest and running totals
"""

__version__ = "0.1.0"
