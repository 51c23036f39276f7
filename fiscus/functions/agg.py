"""Aggregate expressions shared by the analytic plans.

Sums are plain DOUBLE sums over all digits of the values; the last bits
depend on addition order, so statements round their outputs, never their
inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.sum(_c(x).cast("double"))


def cond_sum(pred: Column, x) -> Column:
    """SUM(CASE WHEN pred THEN x ELSE 0 END), the reference's manual pivot."""
    return total(F.when(pred, _c(x)).otherwise(F.lit(0.0)))


def cond_count(pred: Column) -> Column:
    """SUM(CASE WHEN pred THEN 1 ELSE 0 END) as BIGINT."""
    return F.sum(F.when(pred, 1).otherwise(0)).cast("bigint")


def r4(x) -> Column:
    return F.round(_c(x), 4)
