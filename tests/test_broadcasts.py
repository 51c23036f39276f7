"""No join sends a side that grows with the log to the driver and to every task."""

import re

import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A log that measures little as a file and much as rows."""
    d = str(tmp_path_factory.mktemp("log"))
    spark.range(500).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'ECONOMY' AS p_type",
                                "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def broadcasts(df) -> list[str]:
    """Each broadcast of the plan, with what is broadcast."""
    plan = df._jdf.queryExecution().executedPlan().initialPlan().toString().splitlines()
    # a line that begins no node goes on with the text of the one before
    depth = lambda line: len(m[0]) if (m := re.match(r"[ :]*[:+]- ", line)) else 10**6
    found = []
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))
            found.append("\n".join(plan[i:end]))
    return found


@pytest.mark.parametrize("key", ["sql_column_refs", "pair_builder", "hash_split", "sql_clause_levels", "tfidf_link"])
def test_log_is_never_broadcast(spark, sf, key):
    sent = broadcasts(E.queries()[key](spark, sf))
    assert not [b for b in sent if "parquet" in b]


def test_log_is_never_broadcast_without_hints(spark, sf):
    """The catalog is sent as it is known to be smaller, also where hints do not count."""
    spark.conf.set("spark.sql.optimizer.disableHints", "true")
    try:
        sent = broadcasts(E.queries()["sql_column_refs"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.optimizer.disableHints")
    assert len(sent) == 1 and "parquet" not in sent[0]


def test_sparse_joins_send_what_is_short(spark, monkeypatch):
    from fiscus.operators import sparse as S
    monkeypatch.setattr(S, "ROWS_SENT", 3)
    q = spark.createDataFrame([(i, t, 1.0) for i in range(3) for t in "ab"], "qid long, term string, qw double")
    d = spark.createDataFrame([(i, t, 0.5) for i in range(2) for t in "abc"], "iid long, term string, iw double")
    long = S.Postings(q, d)
    assert not (long.short_rows or long.short_asked) and not broadcasts(long.hits(long.asked).select("qid"))[1:]
    short = S.Postings(q.where("qid = 0"), d)
    assert short.short_asked and len(broadcasts(short.hits(short.asked))) == 2
    for p in (long, short):
        assert sorted(map(tuple, p.hits(p.asked).collect())) == sorted(
            (r.qid, i, 0.5) for r in p.asked.collect() for i in range(2))
