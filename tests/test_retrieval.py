"""Retrieval core: any block size gives the same top k; words of all scripts count."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fiscus.operators import retrieval as R
from fiscus.sources.tables import Tables


def test_topk_does_not_depend_on_the_block_size(spark):
    emb = Tables(spark, SF_SMALL).embeddings
    items = R.centroids(emb.withColumn("column_no", R.quadrant(F.col("embedding"))), ["label", "column_no"]) \
        .select((F.col("label") * 10 + F.col("column_no")).alias("item_id"), "vec")
    def rows(df):
        return sorted((r.vec_id, r.rank, r.item_id, round(r.score, 9)) for r in df.collect())
    one = rows(R.dense_topk(emb, "vec_id", "embedding", items, "item_id", "vec", 4))
    assert rows(R.dense_topk(emb, "vec_id", "embedding", items, "item_id", "vec", 4, block_items=3)) == one
    assert len(one) == 4 * emb.count()


def test_token_overlap_min_score(spark):
    q = spark.createDataFrame([(1, ["year", "value"]), (2, ["nothing"])], "id long, qt array<string>")
    items = R.catalog_items(spark)
    got = [sorted(map(tuple, R.topk_items(q, "id", "qt", items, "item_id", "tokens", 3, R.token_overlap,
                                          block_items=b, min_score=1e-12).collect())) for b in (2, 1000)]
    assert got[0] == got[1]
    assert {r[0] for r in got[0]} == {1}


def test_no_items_and_no_queries(spark):
    q = spark.createDataFrame([(1, ["a"])], "id long, qt array<string>")
    none = spark.createDataFrame([], "item_id long, tokens array<string>")
    assert R.topk_items(q, "id", "qt", none, "item_id", "tokens", 3, R.token_overlap).collect() == []
    items = R.catalog_items(spark)
    assert R.topk_items(q.where("id < 0"), "id", "qt", items, "item_id", "tokens", 3, R.token_overlap).collect() == []


def test_words_keep_accented_letters(spark):
    df = spark.createDataFrame([("\u00c9conomie fran\u00e7aise, a\u00f1o se\u00f1al 42",)], "t string")
    assert df.select(R.tokens_lower(F.col("t")).alias("w")).first().w == [
        "\u00e9conomie", "fran\u00e7aise", "a\u00f1o", "se\u00f1al"]


def test_minhash_signatures_estimate_jaccard(spark):
    from fiscus.operators import minhash as M

    a, b = list(range(60)), list(range(20, 80))  # similarity 40 / 80
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(
        *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("a", "b")])
    one = row.select(M.signature(F.col("a"), 512, 1).alias("a"), M.signature(F.col("b"), 512, 1).alias("b")).first()
    assert abs(sum(x == y for x, y in zip(one.a, one.b)) / 512 - 0.5) < 0.1
    keys = row.select(M.band_keys(M.signature(F.col("a"))).alias("k"), M.band_keys(M.signature(F.reverse("a"))).alias("l")).first()
    assert keys.k == keys.l and len(set(keys.k)) == M.BANDS


def test_minhash_finds_what_the_exact_join_finds(spark):
    from fiscus.operators import minhash as M

    t = Tables(spark, "/root/testdata/sf0.01")
    exact = set(map(tuple, R.containment_matches(t.documents, t.benchmark).collect()))
    found = set(map(tuple, M.minhash_matches(t.documents, t.benchmark).collect()))
    assert found <= exact and len(found) >= 0.9 * len(exact) > 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "one two three four")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "x")], "item_id long, text string")
    assert [tuple(r) for r in M.minhash_matches(odd, asked).collect()] == [(4, 1, 2, 1.0)]
