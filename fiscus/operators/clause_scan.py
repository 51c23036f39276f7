"""D-19 with nesting: the clauses of a statement and of every query inside it.

A statement becomes token rows; parentheses add up to a depth along them, and
the last parenthesis opened at a depth is the group of the tokens there.  A
group that begins with SELECT or WITH is a query.  Its clauses reach from one
keyword that stands directly in it to the next; what lies deeper belongs to
their text.  Literals, quoted names and comments are single tokens, so no
keyword is found in them.  All windows are over the tokens of one statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions import sqltext as T
from fiscus.operators.corpus import query_log, with_sql
from fiscus.operators.corpus_queries import d_strip, q, with_ql
from fiscus.plans.registry import register
from fiscus.sources.tables import Tables

col = F.col

_WS = r"[\x20\x09-\x0D]"
#: Keywords of several words are one token; IS DISTINCT FROM is no FROM.
TOKEN = (rf"(?s)--[^\n]*|/\*.*?\*/|'[^']*'|\"[^\"]*\"|(?i:(?:group|order){_WS}+by\b|(?:(?:natural|left|right|full|inner|outer|cross){_WS}+)*join\b"
         rf"|is{_WS}+(?:not{_WS}+)?distinct{_WS}+from\b|(?:union|except|intersect){_WS}+all\b)|\w+|{_WS}+|.")
BLANK = rf"\A(?:--|/\*|{_WS})"
CLAUSES = ("with", "select", "from", "where", "group by", "having", "order by", "limit")
JOIN = rf"\A(?:.*{_WS})?join\z"
SET = rf"\A(?:union|except|intersect)(?:{_WS}+all)?\z"


def clause_levels(statements: DataFrame, id_col: str = "id", sql_col: str = "sql") -> DataFrame:
    """One row per clause: id, query_no (queries of a statement by place, from
    1), level (queries around it), arm (of UNION, EXCEPT, INTERSECT, from 0),
    place (token number), clause (with, select, from, join, where, group by,
    having, order by, limit; set: the operator between arms) and body, without
    comments.  Ids must be unique; null statements have no clauses; an
    unclosed parenthesis reaches to the end."""
    tokens = statements.select(col(id_col).alias("id"), F.regexp_extract_all(col(sql_col), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    rows = (tokens.select("id", F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("at", "tok"))
            .select("id", "n", (col("at") + 1).alias("place"), "tok").where(~col("tok").rlike(BLANK)))
    up, down = (col("tok") == "(").cast("int"), (col("tok") == ")").cast("int")
    along = Window.partitionBy("id").orderBy("place")
    # an opening parenthesis counts to the group that it opens, as the closing one does
    rows = rows.withColumn("depth", F.sum(up - down).over(along) + down)
    rows = rows.withColumn("opened", F.coalesce(F.max(F.when(up == 1, col("place"))).over(
        Window.partitionBy("id", "depth").orderBy("place")), F.lit(0)))
    group = Window.partitionBy("id", "opened").orderBy("place")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(up == 0, F.lower("tok")), ignorenulls=True).over(whole)
    rows = (rows.withColumn("is_query", (col("opened") == 0) | F.coalesce(first.isin("select", "with"), F.lit(False)))
            .withColumn("closed", F.when(col("opened") > 0, F.max(F.when(down == 1, col("place"))).over(whole))))
    rows = rows.withColumn("level", F.sum(F.when(col("is_query") & (col("opened") > 0), up - down).otherwise(0)).over(along))
    word = F.regexp_replace(F.lower("tok"), rf"{_WS}+", " ")
    name = F.when(word.isin(*CLAUSES), word).when(F.lower("tok").rlike(JOIN), "join").when(F.lower("tok").rlike(SET), "set")
    bounds = rows.withColumn("clause", name).where(col("is_query") & col("clause").isNotNull())
    bounds = (bounds.withColumn("end", F.coalesce(F.lead("place").over(group), "closed", col("n") + 1))
              .withColumn("arm", F.sum((col("clause") == "set").cast("int")).over(group))
              .withColumn("query_no", F.dense_rank().over(Window.partitionBy("id").orderBy("opened"))))
    said = F.transform("tokens", lambda t: F.when(t.rlike(r"\A(?:--|/\*)"), F.lit(" ")).otherwise(t))
    body = F.when(col("clause") == "set", F.regexp_replace(F.lower("tok"), rf"{_WS}+", " ")).otherwise(
        T.strip_ws(F.array_join(F.slice("said", col("place") + 1, col("end") - col("place") - 1), "")))
    # the statements are as many as the log has rows: never sent whole
    return (bounds.join(tokens.select("id", said.alias("said")).hint("merge"), "id")
            .select("id", "query_no", col("level").cast("int"), col("arm").cast("int"), col("place").cast("int"), "clause", body.alias("body")))


#: Fixed wrappings of the log's statements, by id modulo 4: subqueries, a CTE, literals and comments that hold keywords.
WRAPPINGS = (
    ("", ""),
    ("WITH c AS (", ") SELECT c.*, 'it''s from (where' AS note FROM c LEFT  JOIN d ON c.k = d.k -- order by (\nWHERE c.k IS NOT DISTINCT FROM d.j GROUP\nBY 1"),
    ("SELECT a, (SELECT max(v) FROM u WHERE u.k = t.k LIMIT 1) AS m FROM (", ") t WHERE v IN (SELECT \"from\" FROM w /* having ( */ WHERE s = 'x) limit') ORDER BY a"),
    ("SELECT EXTRACT(year FROM d), sum(x) OVER (PARTITION BY a ORDER BY b) FROM e UNION  ALL ", " EXCEPT SELECT 1 FROM ((SELECT 2 FROM f) HAVING count(*) > (1"),
)


def _levels_oracle() -> str:
    cases = " ".join(f"WHEN {i} THEN concat({q(a)}, sql, {q(b)})" for i, (a, b) in enumerate(WRAPPINGS))
    names = ", ".join(q(c) for c in CLAUSES)
    return with_ql(f"""
, st AS (SELECT id, regexp_extract_all(CASE id % 4 {cases} END, {q(TOKEN)}) AS tokens FROM ex),
tk AS (SELECT id, len(tokens) AS n, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS place FROM st),
sg AS (SELECT *, lower(tok) AS low FROM tk WHERE NOT regexp_matches(tok, {q(BLANK)})),
dp AS (SELECT *, SUM(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place) + CASE tok WHEN ')' THEN 1 ELSE 0 END AS depth FROM sg),
op AS (SELECT a.*, COALESCE((SELECT MAX(b.place) FROM dp b WHERE b.id = a.id AND b.tok = '(' AND b.depth = a.depth AND b.place <= a.place), 0) AS opened FROM dp a),
gr AS (SELECT id, opened, arg_min(low, place) FILTER (tok <> '(') AS head, MAX(place) FILTER (tok = ')') AS closed FROM op GROUP BY id, opened),
qs AS (SELECT id, opened, CASE WHEN opened > 0 THEN closed END AS closed, dense_rank() OVER (PARTITION BY id ORDER BY opened) AS all_no
       FROM gr WHERE opened = 0 OR head IN ('select', 'with')),
bd AS (SELECT op.id, op.opened, op.place, op.n, qs.closed, regexp_replace(op.low, '{_WS}+', ' ', 'g') AS word,
              CASE WHEN regexp_replace(op.low, '{_WS}+', ' ', 'g') IN ({names}) THEN regexp_replace(op.low, '{_WS}+', ' ', 'g')
                   WHEN regexp_matches(op.low, {q(JOIN)}) THEN 'join' WHEN regexp_matches(op.low, {q(SET)}) THEN 'set' END AS clause
       FROM op JOIN qs USING (id, opened)),
cl AS (SELECT *, COALESCE(lead(place) OVER w, closed, n + 1) AS stop, SUM(CASE clause WHEN 'set' THEN 1 ELSE 0 END) OVER w AS arm,
              dense_rank() OVER (PARTITION BY id ORDER BY opened) AS query_no
       FROM bd WHERE clause IS NOT NULL WINDOW w AS (PARTITION BY id, opened ORDER BY place))
SELECT id, CAST(query_no AS INTEGER) AS query_no,
       CAST((SELECT COUNT(*) FROM qs o WHERE o.id = cl.id AND o.opened > 0 AND o.opened < cl.place AND COALESCE(o.closed, cl.n + 1) > cl.place) AS INTEGER) AS level,
       CAST(arm AS INTEGER) AS arm, CAST(place AS INTEGER) AS place, clause,
       CASE clause WHEN 'set' THEN word ELSE {d_strip("array_to_string([CASE WHEN regexp_matches(x, '^(?:--|/[*])') THEN ' ' ELSE x END FOR x IN tokens[place + 1:stop - 1]], '')")} END AS body
FROM cl JOIN st USING (id)""")


@register("sql_clause_levels", _levels_oracle())
def sql_clause_levels(spark, sf):
    """Clauses of the log's statements, three in four wrapped in further queries."""
    log = with_sql(query_log(Tables(spark, sf)))
    kinds = F.when(col("id") % 4 == 0, col("sql"))
    for i, (a, b) in list(enumerate(WRAPPINGS))[1:]:
        kinds = kinds.when(col("id") % 4 == i, F.concat(F.lit(a), col("sql"), F.lit(b)))
    return clause_levels(log.select("id", kinds.alias("sql")))
