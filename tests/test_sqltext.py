"""Text rules of the query-corpus layer on hand-typed cases (FIXTURES 4)."""

import pytest
from pyspark.sql import functions as F

from fiscus.functions import sqltext as T


def ev(spark, expr_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr_fn(F.col("s"))).collect()]


def test_extract_sql(spark):
    cases = {
        "Answer:\n```sql\nSELECT 1;\n```\nthanks": "SELECT 1;",
        "```SQL\n  select 2\n```": "select 2",
        "```\nSELECT 3\n```": "SELECT 3",
        "  SELECT 4  ": "SELECT 4",
        "```sql\nSELECT 5\n```\n```sql\nSELECT 6\n```": "SELECT 5",
    }
    assert ev(spark, T.extract_sql, list(cases)) == list(cases.values())


def test_extract_sql_select_keeps_leading_with(spark):
    texts = ["Sure: SELECT a FROM t; trailing", "WITH x AS (SELECT 1 AS a) SELECT a FROM x",
             "no query here", "```sql\nselect b from t\n```"]
    assert ev(spark, T.extract_sql_select, texts) == [
        "SELECT a FROM t", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "no query here", "select b from t"]
    assert ev(spark, lambda c: T.extract_sql_select(c, accept_with=False), texts[1:2]) == \
        ["SELECT 1 AS a) SELECT a FROM x"]


def test_normalize_sql(spark):
    assert ev(spark, T.normalize_sql, ["SELECT a,b FROM t WHERE x == 1 AND y != 2",
                                       "  SELECT\n a ,  b\tFROM t  ", "WHERE s = 'a==b'"]) == [
        "SELECT a, b FROM t WHERE x = 1 AND y <> 2", "SELECT a , b FROM t", "WHERE s = 'a=b'"]


def test_normalize_is_idempotent(spark):
    vals = ["SELECT a,b,c FROM t WHERE x==1", "a  !=  b ,c", ""]
    once = ev(spark, T.normalize_sql, vals)
    assert ev(spark, T.normalize_sql, once) == once
    # parity: the comma rule is non-overlapping, so ',,' needs two passes
    assert ev(spark, T.normalize_sql, ["a,,c"]) == ["a, ,c"]


@pytest.mark.parametrize("tok", T.PLACEHOLDERS)
def test_placeholders_any_case(spark, tok):
    assert ev(spark, T.has_placeholder, [f"x = [{tok}]", f"x = [{tok.lower()}]", f"x = {tok}"]) == \
        [True, True, False]


def test_repair_sql(spark):
    vals = ["SELECT observation_value FROM observations o JOIN sectors s ON 1=1;",
            "SELECT value FROM observations WHERE x = 1",
            "SELECT * FROM tax_revenue WHERE name = \"Chile\";;",
            "SELECT 1"]
    got = ev(spark, T.repair_sql, vals)
    assert [(r.sql, r.was_fixed) for r in got] == [
        ("SELECT value FROM gfs_observations o JOIN sectors s ON 1=1", True),
        ("SELECT value FROM gem_observations WHERE x = 1", True),
        ("SELECT * FROM gfs_observations WHERE name = 'Chile'", True),
        ("SELECT 1", False)]


def test_skeleton_and_class(spark):
    sql = "SELECT year, SUM(value) FROM gfs_observations WHERE country_id = 12 AND s = 'x' GROUP BY year"
    assert ev(spark, T.sql_skeleton, [sql]) == [
        "SELECT [YEAR], SUM([METRIC]) FROM gfs_observations WHERE [ID] = [NUMBER] AND s = [STRING] GROUP BY [YEAR]"]
    cls = ev(spark, T.pattern_class, [
        "SELECT a FROM (SELECT 1)", "SELECT a FROM t JOIN u GROUP BY a", "SELECT a FROM t JOIN u",
        "SELECT a FROM t GROUP BY a HAVING 1", "SELECT a FROM t GROUP BY a", "SELECT COUNT(*) FROM t",
        "SELECT a FROM t ORDER BY a", "SELECT a FROM t"])
    assert cls == ["nested_query", "multi_table_aggregation", "multi_table_join", "filtered_aggregation",
                   "grouped_aggregation", "simple_aggregation", "sorted_retrieval", "simple_select"]


def test_table_refs_and_ctes(spark):
    got = ev(spark, T.table_refs, ["SELECT * FROM Countries c JOIN gfs_observations g ON 1 JOIN countries"])
    assert sorted(got[0]) == ["countries", "gfs_observations"]
    assert ev(spark, T.cte_names, ["WITH a AS (SELECT 1), b AS (SELECT 2) SELECT * FROM a"])[0] == ["a", "b"]


def test_clauses(spark):
    c = ev(spark, T.clauses, ["SELECT a, b FROM t JOIN u ON t.x = u.x WHERE a > 1 AND b < 2 "
                              "GROUP BY a HAVING COUNT(*) > 1 ORDER BY a DESC LIMIT 5"])[0]
    assert c.select == "a, b" and c["from"] == "t JOIN u ON t.x = u.x"
    assert c.where == "a > 1 AND b < 2" and c.group_by == "a" and c.having == "COUNT(*) > 1"
    assert c.order_by == "a DESC" and c.limit == "5"


def test_split_guideline_sections(spark):
    from fiscus.operators.corpus import keyword_tags, split_sections
    text = ("Intro line\n# 1. Reminder of mistake\nUse JOIN on gfs_observations.\n\n"
            "# 2. Reminder of mistake\nORDER BY the year; avoid DISTINCT.\n")
    got = ev(spark, split_sections, [text])[0]
    assert [(s.section_no, s.body) for s in got] == [
        (1, "# 1. Reminder of mistake\nUse JOIN on gfs_observations."),
        (2, "# 2. Reminder of mistake\nORDER BY the year; avoid DISTINCT.")]
    tags = ev(spark, keyword_tags, [got[0].body, got[1].body])
    assert tags[0] == ["gfs", "government", "revenue", "expenditure", "tax", "join", "country", "sector", "indicator"]
    assert tags[1] == ["distinct", "order", "sort", "top", "rank"]


def test_normalize_protecting_literals(spark):
    vals = ["SELECT a,b FROM t WHERE s = 'x==y,z' AND n != 2", "WHERE s = 'a  b'"]
    assert ev(spark, lambda c: T.normalize_sql(c, protect_literals=True), vals) == [
        "SELECT a, b FROM t WHERE s = 'x==y,z' AND n <> 2", "WHERE s = 'a  b'"]
    assert ev(spark, T.normalize_sql, vals[:1]) == ["SELECT a, b FROM t WHERE s = 'x=y, z' AND n <> 2"]
