"""Voting: clustering against a checker written from its definition;
majority vote invariant to row order."""

import itertools
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fiscus.operators import voting as V
from fiscus.sources.tables import Tables


def _agree(x, y):
    """Two statements agree when no clause that both have shares under 60 %."""
    shares = [len(set(p) & set(q)) / max(len(p), len(q)) for p, q in zip(x, y) if p and q]
    return min(shares, default=1.0) >= 0.6


def _cluster(rows):
    """rows of one question, every candidate in arrival order -> expected result row."""
    good = [r for r in rows if r["valid"]]
    heads, members = [], []
    for r in good:
        mine = next((n for n, h in enumerate(heads) if _agree(h["clauses"], r["clauses"])), None)
        if mine is None:
            heads.append(r)
            members.append(1)
        else:
            members[mine] += 1
    if not good:
        return (rows[0]["question_id"], rows[0]["fixed"], 0, 0, 0, "first_candidate")
    top = members.index(max(members))
    return (rows[0]["question_id"], heads[top]["fixed"], members[top], len(good), len(heads), "largest_cluster")


def _expected(cands):
    rows = sorted(cands.collect(), key=lambda r: (r.question_id, r.seq, r.l_partkey, r.l_suppkey))
    return sorted(_cluster(list(g)) for _, g in itertools.groupby(rows, key=lambda r: r.question_id))


def test_clusters_match_the_checker(spark):
    cands = V.candidates(Tables(spark, SF_SMALL), V.with_clauses)
    assert sorted(map(tuple, V.candidate_clusters(cands).collect())) == _expected(cands)


def test_clusters_of_hand_made_candidates(spark):
    def cand(q, seq, items, valid=True):
        return (q, seq, seq, 1, "s" + "+".join(items) + str(valid), valid, [items, ["t"], [], [], []])
    rows = [cand(1, 1, ["a", "b", "c"]), cand(1, 2, ["x"]), cand(1, 3, ["a", "b"]), cand(1, 4, ["x"]),
            cand(1, 5, ["a", "b", "c", "d", "e", "f"]),       # 3 of 6: leads its own cluster
            cand(2, 1, ["a"], False), cand(2, 2, ["b"], False),
            cand(3, 1, ["a"], False), cand(3, 2, ["b"]), cand(3, 3, [])]
    df = spark.createDataFrame(rows, "question_id long, seq long, l_partkey long, l_suppkey long, "
                                     "fixed string, valid boolean, clauses array<array<string>>")
    got = sorted(map(tuple, V.candidate_clusters(df.repartition(3)).collect()))
    assert got == _expected(df)
    assert [r[2:] for r in got] == [(2, 5, 3, "largest_cluster"), (0, 0, 0, "first_candidate"),
                                    (2, 2, 1, "largest_cluster")]


def test_majority_vote_order_invariant(spark):
    cands = V.candidates(Tables(spark, SF_SMALL))
    a = sorted(tuple(r) for r in V.majority_vote(cands).collect())
    b = sorted(tuple(r) for r in V.majority_vote(cands.orderBy(F.rand(7)).repartition(5)).collect())
    assert a == b


CANDS = "question_id long, seq long, l_partkey long, l_suppkey long, fixed string, valid boolean, clauses array<array<string>>"


def test_rounds_give_the_fold_of_a_hot_question(spark):
    """One question of 600 candidates, decided two at a time at first: many rounds, rows of members in many tasks."""
    rng = random.Random(5)
    rows = []
    for n in range(600):
        items = [sorted(rng.sample("abcdefgh", rng.randint(0, 5))) for _ in V.T.COMPARED_CLAUSES]
        rows.append((7 if n % 3 else n % 30, n, n, n % 4, str(items), any(items) and rng.random() < 0.9, items))
    df = spark.createDataFrame(rows, CANDS)
    expected = _expected(df)
    for block in (2, V.FIRST_BLOCK):
        assert sorted(map(tuple, V.candidate_clusters(df.repartition(5), block).collect())) == expected
    assert max(r[4] for r in expected) > 20


def test_clusters_of_null_questions_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, 1, 1, "x", True, [["x"]] + [[]] * 4), (None, 2, 2, 1, "y", True, [["y"]] + [[]] * 4),
                                (None, 3, 3, 1, "y", True, [["y"]] + [[]] * 4)], CANDS)
    assert [tuple(r) for r in V.candidate_clusters(df, 1).collect()] == [(None, "y", 2, 3, 2, "largest_cluster")]
    assert V.candidate_clusters(df.limit(0)).collect() == []


def test_votes_by_text_keys(spark):
    """Keys in place of texts give the same answers; null texts and questions count."""
    texts = {1: "SELECT a", 2: "select A", 3: None, 4: "SELECT a", 5: "SELECT b"}
    lines = [(q, n, p, s) for q, row in ((1, [1, 4, 2]), (2, [3, 5]), (3, [5, 2, 1, 3]), (None, [3, 3])) for n, p, s in
             [(n, p, ["structure_specialist", "value_specialist"][(n + (q or 0)) % 2]) for n, p in enumerate(row, 1)]]
    log = spark.createDataFrame(list(texts.items()), "l_partkey long, sql string")
    li = spark.createDataFrame(lines, "question_id long, seq int, l_partkey long, source string").withColumn("l_suppkey", F.lit(1))
    keyed = V.with_text_keys(log)
    got = V.majority_vote(li.join(keyed.drop("sql"), "l_partkey"), keyed)
    plain = V.majority_vote(li.join(log, "l_partkey"))
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    rows = {r.question_id: tuple(r)[1:] for r in got.collect()}
    assert rows[1] == ("SELECT a", "consensus", 3, 2, 3) and rows[None] == (None, "consensus", 2, 1, 2)


def test_questions_within_a_block_are_not_joined_again(spark, monkeypatch):
    """Where no question has more signatures than a block, rows are written twice: signatures and leaders.
    Item sets that only differ in where one ends are other signatures."""
    df = spark.createDataFrame([(1, n, n, 1, str(n), True, c) for n, c in enumerate(
        [[["a"], ["b"]] + [[]] * 3, [["a", "b"], []] + [[]] * 3, [[], ["b"]] + [[]] * 3, [["x"], ["y"]] + [[]] * 3], 1)], CANDS)
    names = []
    monkeypatch.setattr(V, "written", lambda d, name, f=V.written: (names.append(name), f(d, name))[1])
    for block, rounds in ((3, 2), (4, 1)):
        names.clear()
        got = sorted(map(tuple, V.candidate_clusters(df, block).collect()))
        assert got == _expected(df) and names.count("leaders") == rounds and names.count("later") == rounds - 1


def test_log_of_one_file_is_read_by_many_tasks(spark):
    """The texts' rules run in as many tasks as a shuffle has."""
    assert "RoundRobinPartitioning" in V.log_texts(Tables(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
