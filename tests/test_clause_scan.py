"""Clauses by query level: hand-typed statements with subqueries, CTEs, literals and comments."""

from fiscus.operators.clause_scan import clause_levels

CASES = {
    "SELECT a, b FROM t WHERE x = 'a from (b' GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3": [
        (1, 0, 0, "select", "a, b"), (1, 0, 0, "from", "t"), (1, 0, 0, "where", "x = 'a from (b'"), (1, 0, 0, "group by", "a"),
        (1, 0, 0, "having", "count(*) > 1"), (1, 0, 0, "order by", "a"), (1, 0, 0, "limit", "3")],
    "SELECT v FROM t WHERE k IN (SELECT k FROM u WHERE z > 1) AND w = 2": [
        (1, 0, 0, "select", "v"), (1, 0, 0, "from", "t"), (1, 0, 0, "where", "k IN (SELECT k FROM u WHERE z > 1) AND w = 2"),
        (2, 1, 0, "select", "k"), (2, 1, 0, "from", "u"), (2, 1, 0, "where", "z > 1")],
    "with c as (select 1 from (select 2 from d) e) select * from c left  outer join f on c.a = f.a -- where\n": [
        (1, 0, 0, "with", "c as (select 1 from (select 2 from d) e)"), (1, 0, 0, "select", "*"), (1, 0, 0, "from", "c"),
        (1, 0, 0, "join", "f on c.a = f.a"), (2, 1, 0, "select", "1"), (2, 1, 0, "from", "(select 2 from d) e"),
        (3, 2, 0, "select", "2"), (3, 2, 0, "from", "d")],
    "SELECT EXTRACT(year FROM d), sum(x) OVER (ORDER BY b) /* limit 2 */ FROM \"where\" UNION ALL SELECT 1": [
        (1, 0, 0, "select", "EXTRACT(year FROM d), sum(x) OVER (ORDER BY b)"), (1, 0, 0, "from", "\"where\""), (1, 0, 1, "set", "union all"),
        (1, 0, 1, "select", "1")],
    "SELECT a FROM (SELECT b FROM t WHERE c IS NOT DISTINCT FROM d": [
        (1, 0, 0, "select", "a"), (1, 0, 0, "from", "(SELECT b FROM t WHERE c IS NOT DISTINCT FROM d"),
        (2, 1, 0, "select", "b"), (2, 1, 0, "from", "t"), (2, 1, 0, "where", "c IS NOT DISTINCT FROM d")],
    "a ) select 1 ) from (b": [(1, 0, 0, "select", "1 )"), (1, 0, 0, "from", "(b")],
    "": [], "no sql 'at all": [], None: [],
}


def test_clauses_of_nested_statements(spark):
    rows = list(enumerate(CASES))
    got = {i: [] for i, _ in rows}
    for r in sorted(clause_levels(spark.createDataFrame(rows, "id long, sql string")).collect(), key=lambda r: (r.id, r.query_no, r.place)):
        got[r.id].append((r.query_no, r.level, r.arm, r.clause, r.body))
    for i, sql in rows:
        assert got[i] == CASES[sql], sql
    assert clause_levels(spark.createDataFrame([], "id long, sql string")).count() == 0


def test_long_statements(spark):
    """Depth of hundreds, and many clauses, in one statement."""
    deep = "SELECT a FROM (" * 200 + "t" + ")" * 200
    rows = clause_levels(spark.createDataFrame([(1, deep)], "id long, sql string")).collect()
    assert sorted((r.level, r.clause) for r in rows) == sorted((i, c) for i in range(200) for c in ("from", "select"))
