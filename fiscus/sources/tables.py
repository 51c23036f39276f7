"""Access to the driver's parquet tables (S8: stored-table scan).

Each attribute is a lazy ``spark.read.parquet`` so Catalyst prunes columns
and pushes filters into the scan of every query that uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """``Tables(spark, "/root/testdata/sf0.01").lineitem`` -> DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)

    def register_views(self) -> None:
        """Temp views under the driver's table names, for ``spark.sql``."""
        for name in TABLE_NAMES:
            self.read(name).createOrReplaceTempView(name)
