"""Rows of conversations in order, cut over tasks.

Rows are dealt by ranges of (conversation, turn, digest of role and text), so
a conversation of any length is spread over tasks and stays in order.  A task
reads its rows as stretches: most hold one whole conversation; those at the
two ends of a task, and pieces of a conversation longer than ``most`` rows or
characters, are parts, to be put together by their number.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, *more) -> DataFrame:
    """(conv, turn, role, text, digest, more): digest is the SHA-256 of role, line feed and text."""
    d = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                    F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
    both = F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return d.withColumn("digest", F.unhex(F.sha2(both, 256)))


def in_order(rows: DataFrame, *then: str) -> DataFrame:
    """Rows by (conv, turn, digest), nulls first, in ranges.  Rows equal in all
    three stand in one task, next to each other, by ``then``."""
    by = ["conv", "turn", "digest"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by, *then)


def stretches(batches, size, most: int):
    """(number, conv, rows, whole) of a task's rows, tuples that begin with
    their conversation.  ``size(row)`` adds up to ``most`` before a part ends.
    Numbers rise along the table's order."""
    number = TaskContext.get().partitionId() << 40
    held, total, conv, begun, cut = [], 0, None, False, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and row[0] != conv:
                if held:
                    yield number, conv, held, not cut
                    number += 1
                held, total, cut = [], 0, False
            elif total >= most:
                yield number, conv, held, False
                number += 1
                held, total, cut = [], 0, True
            conv, begun = row[0], True
            held.append(row)
            total += size(row)
    if held:
        yield number, conv, held, False
