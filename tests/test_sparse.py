"""Sparse top-k with pruning against all scores, with hot terms cut into parts, and the postings that it leaves out."""

import random

from pyspark.sql import functions as F

from fiscus.operators import sparse as S


def _tables(spark, n_items=300, n_questions=40):
    rng = random.Random(8)
    def rows(n, top):
        out = []
        for i in range(n):
            terms = {"the"} | {f"t{int(60 * rng.random() ** 3)}" for _ in range(rng.randint(0, 12))}
            out += [(i, t, rng.randint(1, top) / 8 if t != "the" else 1 / 8) for t in sorted(terms)]
        return out
    items, asked = rows(n_items, 16), rows(n_questions, 8) + [(1000, "unknown", 1.0)]
    return asked, items, spark.createDataFrame(asked, "qid long, term string, qw double"), spark.createDataFrame(items, "iid long, term string, iw double")


def _all(asked, items, k):
    by_item, by_q = {}, {}
    for i, t, w in items:
        by_item.setdefault(i, {})[t] = w
    for q, t, w in asked:
        by_q.setdefault(q, {})[t] = w
    out = []
    for q, terms in by_q.items():
        scores = [(-sum(w * v[t] for t, w in terms.items() if t in v), i) for i, v in by_item.items() if terms.keys() & v.keys()]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_is_that_of_all_scores(spark):
    asked, items, q, d = _tables(spark)
    for k, part_rows, seeds in ((1, 50_000, 3), (4, 7, 1), (10, 50, 3)):
        got = sorted(map(tuple, S.sparse_topk(q, d, k, part_rows, seeds).collect()))
        assert got == _all(asked, items, k)


def test_postings_are_pruned(spark):
    _, _, q, d = _tables(spark)
    p = S.Postings(q, d, 20)
    split = p.split(3)
    assert p.hits(split.where("needed")).count() < 0.8 * p.hits(p.asked).count()
    assert p.rows.where("term = 'the'").select("part").distinct().count() == 15


def test_nothing_asked_and_nothing_held(spark):
    _, _, q, d = _tables(spark, 5, 2)
    assert S.sparse_topk(q.limit(0), d, 3).collect() == [] == S.sparse_topk(q, d.limit(0), 3).collect()
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta"), (4, "alpha gamma"), (4, "delta")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "beta"), (2, None), (3, "none of it")], "item_id long, text string")
    assert [(r.item_id, r.doc_id) for r in S.tfidf_passages(docs, asked, 2).collect()] == [(1, 3)]
