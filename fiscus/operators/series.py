"""W2 / W7 over a series of any length: lag and running total as a prefix scan.

A window over a series puts the whole series in one task.  Here its rows are
cut into slices of the (series, order) range; each slice is scanned by its own
window, and what earlier slices carry over (the last value, the sum) comes
from a table of one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.operators.ingest import with_key_slices
from fiscus.plans.registry import register
from fiscus.sources.tables import Tables

col = F.col


def prefix_scan(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str,
                prev: str = "previous_value", running: str = "running_total", slices: int | None = None) -> DataFrame:
    """``df`` with ``LAG(value)`` and ``SUM(value)`` over (PARTITION BY series
    ORDER BY order), the sum in the default RANGE frame (rows of equal order share it).

    Rows of equal order are lagged by value, nulls first.  Nulls count as no
    addend; a total before any value is null.  A null series is a series; an
    empty table gives no rows."""
    series, order = list(series), list(order)
    cut = with_key_slices(df, [*series, *order], slices)
    within = Window.partitionBy(*series, "_slice")
    local = within.orderBy(*order, value)
    upto = within.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (cut.withColumn("_lag", F.lag(value).over(local)).withColumn("_nth", F.row_number().over(local))
            .withColumn("_sum", F.sum(col(value).cast("double")).over(upto)))
    ends = cut.groupBy(*series, "_slice").agg(F.max_by(value, F.struct(*order, value)).alias("_last"),
                                              F.sum(col(value).cast("double")).alias("_total"))
    of_series = (Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))).orderBy("_slice")
    carried = ends.select(
        *[col(s).alias(f"_g_{s}") for s in series], col("_slice").alias("_s"), F.lag("_last").over(of_series).alias("_before"),
        F.sum("_total").over(of_series.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    same = col("_slice") == col("_s")
    for s in series:
        same = same & col(s).eqNullSafe(col(f"_g_{s}"))
    total = F.when(col("_sum").isNotNull() | col("_carry").isNotNull(),
                   F.coalesce("_carry", F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0)))
    return rows.join(carried, same).select(
        *[col(c) for c in df.columns], F.when(col("_nth") == 1, col("_before")).otherwise(col("_lag")).alias(prev),
        total.alias(running))


@register("series_prefix_scan", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey,
       LAG(l_extendedprice) OVER (s ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
         AS previous_value,
       ROUND(SUM(l_extendedprice) OVER (s ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey), 2) AS running_total
FROM lineitem WINDOW s AS (PARTITION BY l_returnflag)""")
def series_prefix_scan(spark, sf):
    """Three series that hold all rows, each cut over many tasks."""
    li = Tables(spark, sf).lineitem.select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                           "l_extendedprice")
    out = prefix_scan(li, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_extendedprice")
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "previous_value",
                      F.round("running_total", 2).alias("running_total"))
