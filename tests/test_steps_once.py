"""Steps that were computed several times, and what they give."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from fiscus.operators import corpus as C
from fiscus.operators import retrieval as R
from fiscus.operators import sparse as S

SF = "/root/testdata/sf0.001"


def test_synonyms_are_replaced_once_a_row(spark):
    texts = ["Show total revenue by Year", "show the USA and uk", "no term at all", None, "", "Count count GDP growth"]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, "Show it")]
    out = C.synonym_augment(spark.createDataFrame(rows, "id long, question string"))
    expected = []
    for i, text in rows:
        reps, new = [], text
        for n, (term, syns) in enumerate(C.SYNONYMS):
            if new and re.search(rf"(?i)\b{term}\b", new):
                if i is None:  # nothing can be chosen: the text is lost, and the row tells
                    new, reps = None, [""]
                    break
                choice = syns[(i + n) % len(syns)]
                new, reps = re.sub(rf"(?i)\b{term}\b", choice, new), [*reps, f"{term}->{choice}"]
        if reps:
            expected.append((i, new, text, "synonym", ";".join(reps)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(", plan)) == len(C.SYNONYMS)


def test_facts_are_joined_once_for_all_statements(spark):
    E.queries()["execution_accuracy"](spark, SF)
    for name in ("gfs_observations", "gem_observations"):
        assert "Join" not in spark.table(name)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, None), (4, "")], "doc_id long, text string")
    sent = R.tfidf_top_terms(docs, "doc_id", "text", 2)
    assert "regexp_extract_all" not in sent._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(R, "WORDS_SENT", 1)
    merged = R.tfidf_top_terms(docs, "doc_id", "text", 2)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, merged.collect()))
    assert [(r.doc_id, r["rank"], r.term) for r in sent.orderBy("doc_id", "rank").collect()] == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c"), (2, 2, "a")]


def test_weights_of_asked_terms_are_of_whole_texts(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "b", 1), (2, "z", 2)], "id long, term string, n long")
    idf = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("z", 0.0)], "term string, idf double")
    got = S.unit_tfidf(counts, idf, spark.createDataFrame([("b",)], "term string")).orderBy("id").collect()
    assert [(r.id, r.term, r.w) for r in got] == [(1, "b", 0.8), (2, "b", 1.0)]
    assert S.unit_tfidf(counts, idf).where(F.col("term") == "a").first().w == 0.6
