"""Facts stored for the star join: bucketed by a dimension key, hot keys over several buckets.

A fact table bucketed by its key joins that dimension without moving a fact.
A key that holds more than a bucket's share of the rows is split: its rows
are dealt over several parts, and only its dimension row is repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.plans.registry import register
from fiscus.plans.star import Star, with_star
from fiscus.session import ensure_checkpoint_dir, written

col = F.col

PART = "_part"


@dataclass
class BucketedFacts:
    """``facts`` read from a table bucketed by (key, part); ``hot`` has
    (key, parts) of the keys with several parts, fewer rows than buckets."""
    facts: DataFrame
    hot: DataFrame
    key: str

    def join(self, dim: DataFrame) -> DataFrame:
        """Facts with the columns of ``dim``, one row per key; only ``dim`` moves."""
        parts = dim.join(F.broadcast(self.hot), self.key, "left").select(
            *[col(c) for c in dim.columns],
            F.explode(F.sequence(F.lit(0), F.coalesce(col("parts"), F.lit(1)) - 1)).alias(PART))
        return self.facts.join(parts, [self.key, PART]).drop(PART)


def write_bucketed(facts: DataFrame, key: str, buckets: int, name: str = "facts") -> BucketedFacts:
    """Write ``facts`` as a table of ``buckets`` buckets.  A key gets one part
    for each share (rows / buckets) that it fills, so fewer keys than buckets
    are hot and their list can be broadcast.  The part of a row follows from its
    columns, so a repeated task writes the same; rows equal in all columns
    share a part.  Rows without a key are kept and join nothing."""
    spark = facts.sparkSession
    counts = written(facts.where(col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    share = counts.agg((F.sum("n") / buckets).alias("share"))
    hot = written(counts.join(F.broadcast(share)).select(key, F.ceil(col("n") / col("share")).cast("int").alias("parts"))
                  .where("parts > 1"), "hot-keys")
    dealt = facts.join(F.broadcast(hot), key, "left").select(
        *[col(c) for c in facts.columns],
        F.coalesce(F.pmod(F.xxhash64(*facts.columns), col("parts")), F.lit(0)).cast("int").alias(PART))
    table = f"{name}_{uuid.uuid4().hex}"
    (dealt.repartition(buckets, key, PART).write.format("parquet").bucketBy(buckets, key, PART).sortBy(key)
     .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}").saveAsTable(table))
    return BucketedFacts(spark.table(table), hot, key)


@register("bucketed_star_join", with_star("""
SELECT i.unit, g.transformation, CAST(COUNT(*) AS BIGINT) AS n_obs, ROUND(AVG(g.value), 4) AS avg_value
FROM gfs_observations g JOIN indicators i ON g.indicator_id = i.indicator_id
GROUP BY i.unit, g.transformation"""))
def bucketed_star_join(spark, sf):
    star = Star(spark, sf)
    stored = write_bucketed(star.gfs(), "indicator_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (stored.join(star.indicators().select("indicator_id", "unit")).groupBy("unit", "transformation")
            .agg(F.count(F.lit(1)).alias("n_obs"), F.round(F.avg("value"), 4).alias("avg_value")))
