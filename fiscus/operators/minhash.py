"""D-37: approximate value matching by MinHash signatures and LSH bands.

Values are sentences.  A signature has 128 values: for 32 fixed permutations
of the 64-bit space (h xor c) the four least images of the value's shingle
hashes; the four of one permutation are a band, and a band in common makes a
pair a candidate.  Signatures and bands are column expressions of one row:
shingles never leave it.  What is joined are band keys, documents' against
passages', and Spark broadcasts the latter while it measures them small.
Candidates are verified on their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.operators.retrieval import shingles, tokens_lower
from fiscus.plans.registry import ORACLE, register
from fiscus.sources.tables import Tables

col = F.col

BANDS, ROWS = 32, 4


def signature(hashes: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """MinHash of an array of distinct 64-bit hashes: per band, the ``rows``
    least images under one permutation.  Those of two sets of Jaccard
    similarity s are equal with probability s^rows, up to the sets' size."""
    points = F.array(*[F.xxhash64(F.lit(i)) for i in range(bands)])
    return F.transform(points, lambda c: F.slice(F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(c))), 1, rows))


def band_keys(sig: Column) -> Column:
    """One 64-bit key per band.  A pair of similarity s shares a band with
    probability 1 - (1 - s^rows)^bands: 0.87 at 0.5, 0.99 at 0.6 with 32 bands of 4."""
    return F.transform(sig, lambda least, band: F.xxhash64(band, least))


def sentences(text: Column) -> Column:
    """Sentences and lines of a text (cut behind sentence marks and at line ends)."""
    return F.split(text, r"(?<=[.!?])[\x20\t]+|\n")


def value_bands(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, band): band keys of the sentences of every text that have ``n``
    words.  The arrays are exploded as outer: Spark would test an inner
    explode's array in a filter below it, and so compute each of them twice."""
    units = df.select(col(key), F.explode_outer(sentences(col(text))).alias("_u")).select(key, tokens_lower(col("_u")).alias("_w"))
    hashed = units.select(key, F.transform(shingles(col("_w"), n), lambda s: F.xxhash64(s)).alias("_h"))
    keys = F.when(F.size("_h") > 0, band_keys(signature(col("_h"))))
    return hashed.select(key, F.explode_outer(keys).alias("band")).where("band IS NOT NULL")


def minhash_candidates(docs: DataFrame, passages: DataFrame, n: int = 3) -> DataFrame:
    """Distinct (doc_id, item_id) with a band in common.  The passages' keys
    are made distinct first; pairs are combined in the tasks, so a sentence in
    a third of all documents gives a pair per document and passage, once."""
    keys = value_bands(passages, "item_id", "text", n).distinct()
    return value_bands(docs, "doc_id", "text", n).join(keys, "band").select("doc_id", "item_id").distinct()


def minhash_matches(docs: DataFrame, passages: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """Passages whose word shingles are at least ``threshold`` contained in a
    document, among those that LSH finds: (doc_id, item_id, shared,
    containment), containment exact.  A passage is found when one of its
    sentences is similar to one of the document's; texts without a sentence of
    ``n`` words, and null texts, match nothing.  Ids must be unique and not null."""
    pairs = minhash_candidates(docs, passages, n)
    words = passages.select("item_id", tokens_lower(col("text")).alias("_w"))
    asked = pairs.join(words.select("item_id", shingles(col("_w"), n).alias("_p")), "item_id")
    told = docs.select("doc_id", tokens_lower(col("text")).alias("_w")).join(asked, "doc_id")
    told = told.select("doc_id", "item_id", "_p", shingles(col("_w"), n).alias("_d"))
    both = told.select("doc_id", "item_id", F.size("_p").alias("_n"), F.size(F.array_intersect("_d", "_p")).cast("bigint").alias("shared"))
    return (both.where(col("shared") / col("_n") >= threshold)
            .select("doc_id", "item_id", "shared", F.round(col("shared") / col("_n"), 4).alias("containment")))


@register("value_match_minhash", ORACLE["value_match_jaccard"])
def value_match_minhash(spark, sf):
    """Same contract as value_match_jaccard; the SQL is that of the exact
    join, so the check holds the recall of the index as well as its rows."""
    t = Tables(spark, sf)
    return minhash_matches(t.documents, t.benchmark)
