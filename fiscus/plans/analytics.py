"""Reusable frame -> frame analytics (the reference's SQL idioms as functions).

All functions are lazy and keep work inside built-in expressions.  Windows
always take a partition key: a series window over an unpartitioned frame
would collapse to one task at scale, so callers pass the entity key (for a
single-entity series the key is constant after the filter, same result).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions.agg import cond_count, cond_sum, total


def one_per_period(df: DataFrame, keys: Sequence[str], value: str = "value",
                   out: str = "value", how: str = "sum") -> DataFrame:
    """Collapse a fact to one row per (entity, period) before series windows."""
    agg = total(value) if how == "sum" else F.avg(value)
    return df.groupBy(*keys).agg(agg.alias(out))


def with_lag(df: DataFrame, part: Sequence[str], order: str, value: str,
             prev: str = "previous_value") -> DataFrame:
    """Previous value in the series (NULL for the first period)."""
    w = Window.partitionBy(*part).orderBy(order)
    return df.withColumn(prev, F.lag(value).over(w))


def yoy_pct(cur: str, prev: str, digits: int | None = 2) -> Column:
    """(cur - prev) / prev * 100, NULL when prev is NULL or 0."""
    pct = F.try_divide(F.col(cur) - F.col(prev), F.nullif(F.col(prev), F.lit(0))) * 100
    return F.round(pct, digits) if digits is not None else pct


def running_total(df: DataFrame, part: Sequence[str], order: str, value: str,
                  out: str = "running_total") -> DataFrame:
    """SUM(x) OVER (ORDER BY k) with the default RANGE frame (peers included)."""
    w = (Window.partitionBy(*part).orderBy(order)
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(F.col(value).cast("double")).over(w))


def conditional_pivot(df: DataFrame, keys: Sequence[str], label: Column,
                      cases: dict[str, object], value: str = "value") -> DataFrame:
    """One column per case, SUM(CASE WHEN label = v THEN value ELSE 0 END).

    Missing combinations are 0 (reference parity), unlike ``groupBy.pivot``
    which yields NULL.
    """
    aggs = [cond_sum(label == F.lit(v), value).alias(name) for name, v in cases.items()]
    return df.groupBy(*keys).agg(*aggs)


def presence_guard(df: DataFrame, keys: Sequence[str], label: Column,
                   cases: dict[str, object], value: str = "value") -> DataFrame:
    """A9 + A12: conditional pivot kept only where every case has a row."""
    aggs = [cond_sum(label == F.lit(v), value).alias(name) for name, v in cases.items()]
    flags = [cond_count(label == F.lit(v)).alias(f"_n_{name}") for name, v in cases.items()]
    out = df.groupBy(*keys).agg(*aggs, *flags)
    for name in cases:
        out = out.where(F.col(f"_n_{name}") > 0)
    return out.drop(*[f"_n_{name}" for name in cases])


def argmin_per_group(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group under ``order`` (ROW_NUMBER() = 1)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """ORDER BY .. LIMIT n (TakeOrderedAndProject: per-partition top n)."""
    return df.orderBy(*order).limit(n)


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row.

    The right side is a global aggregate, so its size is exactly one row and
    broadcasting it is always safe.
    """
    return (df.withColumn("_one", F.lit(1))
              .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one")
              .drop("_one"))


def cagr_pct(first: str, last: str, periods: int) -> Column:
    """(POWER(last / first, 1 / periods) - 1) * 100."""
    return (F.pow(F.col(last) / F.col(first), F.lit(1.0 / periods)) - 1) * 100


def coverage_counts(df: DataFrame, key: str, distinct_cols: Sequence[str],
                    count_name: str = "total_observations") -> DataFrame:
    """Several COUNT(DISTINCT ..) plus COUNT(*) per key in one pass over
    ``df``; each task combines its rows per (key, value) before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name),
                               *[F.countDistinct(c).alias(f"n_{c}") for c in distinct_cols])
