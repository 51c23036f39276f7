"""Exact deduplication with DataFrame operations only.

Rows are grouped by a 128-bit hash of the whole text and, inside a hash
group, by the text itself: equality is decided on bytes, so two texts that
collide never merge.  Grouping combines on the map side, so a text that a
third of all rows carry reaches the shuffle once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import text_or_empty, written


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128=md5_128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    largest id stays (``keep_id``).  Null ids are smaller than any id: a group
    of null ids alone has a null keep_id and keeps its rows.  Rows that repeat
    an id with the same text count each in group_size and share the flag.
    Extra columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("t"))
    d = d.withColumn("h", hash128(F.col("t"))).withColumn("s", F.sha2("t", 256))
    # bytes are compared here: the text is a grouping key
    texts = d.groupBy("h", "s", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # (hash, SHA-256) names the text group for the way back; should two texts
    # ever share both, the job stops instead of merging them
    groups = (texts.groupBy("h", "s").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                                          F.count(F.lit(1)).alias("texts"))
              .where("group_size > 1 or texts > 1")
              .withColumn("group_size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long"))
                          .otherwise(F.col("group_size"))).drop("texts"))
    # only groups of several rows are kept, as a table of known size: the join
    # is a broadcast if that is small, else one whose hot keys Spark can split
    groups = written(groups, "copies")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return (d.select("id", "h", "s").join(groups, ["h", "s"], "left")
            .select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.col("id").eqNullSafe(keep).alias("kept"), F.col("s").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128=md5_128) -> DataFrame:
    """The rows that stay, with all their columns: one per distinct text, that
    with the largest id (rows that repeat the id: the largest row)."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    t = text_or_empty(text_col)
    row = F.struct(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").isNotNull().alias("c1"),
                   *[F.col(f"`{c}`").alias(f"c{i + 2}") for i, c in enumerate(rest)])
    best = docs.select(hash128(t).alias("h"), t.alias("t"), row.alias("r")).groupBy("h", "t").agg(F.max("r").alias("r"))
    out = {id_col: F.col("r.c0"), text_col: F.when(F.col("r.c1"), F.col("t"))}
    out |= {c: F.col(f"r.c{i + 2}") for i, c in enumerate(rest)}
    return best.select(*[out[c].alias(c) for c in docs.columns])
