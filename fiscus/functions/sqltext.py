"""SQL-text column expressions (query-corpus layer L4).

Each function maps Column -> Column and compiles to built-in regexp /
string / array expressions, so a corpus of any size is processed inside
whole-stage codegen with no Python worker.  Patterns stay in the subset
shared by Java regex and RE2 (inline ``(?is)`` flags, lazy ``.*?``, ``\\z``
for end of text), so an ANSI-SQL engine can reproduce every result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder tokens that mark a templated (unusable) SQL.
PLACEHOLDERS = ("YEAR", "METRIC", "STRING", "ID", "VALUE", "NUMBER", "TABLE", "COLUMN", "CODE")
PLACEHOLDER_RE = r"(?i)\[(" + "|".join(PLACEHOLDERS) + r")\]"

# Skeleton column placeholders, applied in this order.
SKELETON_COLUMNS = (
    ("revenue", "[METRIC]"),
    ("expenditure", "[METRIC]"),
    ("value", "[METRIC]"),
    ("country_id", "[ID]"),
    ("indicator_code", "[CODE]"),
    ("year", "[YEAR]"),
)

FENCE_SQL_RE = r"(?is)```sql\s*(.*?)\s*```"
FENCE_ANY_RE = r"(?s)```\s*(.*?)\s*```"
SELECT_RE = r"(?is)(SELECT\s+.*?)(;|\z)"
WITH_OR_SELECT_RE = r"(?is)(\bWITH\s+\w+\s+AS\s*\(.*?|SELECT\s+.*?)(;|\z)"
TABLE_REF_RE = r"(?i)(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
CTE_NAME_RE = r"(?i)(?:\bWITH|,)\s*([a-zA-Z_][a-zA-Z0-9_]*)\s+AS\s*\("
QUALIFIED_RE = r"([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)"
WORD_RE = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"

_END = r"(?:;|\z)"
CLAUSE_RE = {
    "select": r"(?is)\bSELECT\s+(.*?)\s+FROM\b",
    "from": r"(?is)\bFROM\s+(.*?)(?:\s+(?:WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT)\b|" + _END + ")",
    "join": r"(?is)\bJOIN\s+(.*?)(?:\s+(?:WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT)\b|" + _END + ")",
    "where": r"(?is)\bWHERE\s+(.*?)(?:\s+(?:GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT)\b|" + _END + ")",
    "group_by": r"(?is)\bGROUP\s+BY\s+(.*?)(?:\s+(?:HAVING|ORDER\s+BY|LIMIT)\b|" + _END + ")",
    "having": r"(?is)\bHAVING\s+(.*?)(?:\s+(?:ORDER\s+BY|LIMIT)\b|" + _END + ")",
    "order_by": r"(?is)\bORDER\s+BY\s+(.*?)(?:\s+LIMIT\b|" + _END + ")",
    "limit": r"(?is)\bLIMIT\s+(\d+)",
}
COMPARED_CLAUSES = ("select", "from", "where", "group_by", "order_by")


# the regex class \s: space, tab, newline, vertical tab, form feed, return
WS_CHARS = " \t\n\x0b\x0c\r"


def strip_ws(c: Column) -> Column:
    """``str.strip()`` over the regex-whitespace characters (a plain trim)."""
    return F.btrim(c, F.lit(WS_CHARS))


def extract_sql(text: Column) -> Column:
    """D-1: ```sql fenced block, else any fenced block, else the text."""
    fenced = text.contains("```")  # cheap test first: most answers have no fence
    return (F.when(~fenced, strip_ws(text))
             .when(text.rlike(FENCE_SQL_RE), strip_ws(F.regexp_extract(text, FENCE_SQL_RE, 1)))
             .when(text.rlike(FENCE_ANY_RE), strip_ws(F.regexp_extract(text, FENCE_ANY_RE, 1)))
             .otherwise(strip_ws(text)))


def extract_sql_select(text: Column, accept_with: bool = True) -> Column:
    """D-2: drop fences, then the first ``SELECT ...`` up to ``;`` or the end.

    ``accept_with=True`` also accepts a leading ``WITH name AS (`` so a CTE
    statement is not cut down to its first inner SELECT (reference loses it).
    """
    t = F.regexp_replace(F.regexp_replace(text, r"```sql\s*", ""), r"```\s*", "")
    pat = WITH_OR_SELECT_RE if accept_with else SELECT_RE
    return F.when(t.rlike(pat), strip_ws(F.regexp_extract(t, pat, 1))).otherwise(strip_ws(t))


def extract_from_assistant(content: Column) -> Column:
    """D-3: fenced ```sql block (whitespace required), else SELECT to end."""
    fence = r"(?s)```sql\s+(.*?)\s+```"
    sel = r"(?is)(SELECT\s+.*)"
    return (F.when(content.rlike(fence), strip_ws(F.regexp_extract(content, fence, 1)))
             .when(content.rlike(sel), strip_ws(F.regexp_extract(content, sel, 1)))
             .otherwise(strip_ws(content)))


def _normalize_piece(s: Column) -> Column:
    s = F.replace(s, F.lit("=="), F.lit("="))
    s = F.replace(s, F.lit("!="), F.lit("<>"))
    s = F.regexp_replace(s, r",([^\s])", ", $1")
    return F.regexp_replace(s, r"\s+", " ")


def normalize_sql(sql: Column, protect_literals: bool = False) -> Column:
    """D-4: ``==``->``=``, ``!=``->``<>``, space after comma, collapse whitespace.

    Default (parity): like the reference, text inside quotes is rewritten
    too.  ``protect_literals=True`` splits on single quotes and rewrites
    only the pieces outside string literals (even positions)."""
    if not protect_literals:
        return strip_ws(_normalize_piece(sql))
    pieces = F.split(sql, "'")
    kept = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, _normalize_piece(x)).otherwise(x))
    return strip_ws(F.array_join(kept, "'"))


def has_placeholder(sql: Column) -> Column:
    """D-5: any of the nine ``[TOKEN]`` placeholders, case-insensitive."""
    return sql.rlike(PLACEHOLDER_RE)


def repair_sql(sql: Column) -> Column:
    """D-6: rule-based repair -> struct(sql, was_fixed)."""
    s = F.regexp_replace(sql, r"(?i)\bobservation_value\b", "value")
    s = F.when(s.rlike(r"(?i)\bFROM\s+observations\b"),
               F.when(F.lower(s).contains("sector"),
                      F.regexp_replace(s, r"(?i)\bobservations\b", "gfs_observations"))
                .otherwise(F.regexp_replace(s, r"(?i)\bobservations\b", "gem_observations"))
               ).otherwise(s)
    s = F.regexp_replace(s, r"(?i)\bFROM\s+tax_revenue\b", "FROM gfs_observations")
    s = F.regexp_replace(s, r"(\w+)\s*=\s*\"([^\"]+)\"", "$1 = '$2'")
    s = strip_ws(F.regexp_replace(s, r";+\z", ""))
    return F.struct(s.alias("sql"), (s != sql).alias("was_fixed"))


def sql_skeleton(sql: Column) -> Column:
    """D-8: literals -> [STRING], numbers -> [NUMBER], known columns -> tags."""
    s = F.regexp_replace(sql, r"'[^']*'", "[STRING]")
    s = F.regexp_replace(s, r"\b\d+\b", "[NUMBER]")
    for name, tag in SKELETON_COLUMNS:
        s = F.regexp_replace(s, r"(?i)\b" + name + r"\b", tag)
    return s


def _count_sub(u: Column, token: str) -> Column:
    return F.floor((F.length(u) - F.length(F.replace(u, F.lit(token), F.lit("")))) / len(token))


def pattern_class(sql: Column) -> Column:
    """D-9: eight ordered rules on the upper-cased text."""
    u = F.upper(sql)
    has_join, has_group, has_having = u.contains("JOIN"), u.contains("GROUP BY"), u.contains("HAVING")
    has_sub = _count_sub(u, "SELECT") > 1
    has_agg = (u.contains("SUM(") | u.contains("AVG(") | u.contains("COUNT(")
               | u.contains("MAX(") | u.contains("MIN("))
    return (F.when(has_sub, "nested_query")
             .when(has_join & has_group, "multi_table_aggregation")
             .when(has_join, "multi_table_join")
             .when(has_group & has_having, "filtered_aggregation")
             .when(has_group, "grouped_aggregation")
             .when(has_agg, "simple_aggregation")
             .when(u.contains("ORDER BY"), "sorted_retrieval")
             .otherwise("simple_select"))


def table_refs(sql: Column) -> Column:
    """D-13: lower-cased distinct names after FROM / JOIN."""
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(TABLE_REF_RE), 1), F.lower))


def cte_names(sql: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(CTE_NAME_RE), 1), F.lower))


def words(sql: Column) -> Column:
    """Identifier-like words (lower-cased, distinct) for column matching."""
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(WORD_RE), 1), F.lower))


def clause(sql: Column, name: str) -> Column:
    """D-19: one top-level clause body (NULL when absent)."""
    return F.nullif(strip_ws(F.regexp_extract(sql, CLAUSE_RE[name], 1)), F.lit(""))


def clause_items(body: Column, name: str) -> Column:
    """Clause body -> distinct lower-cased items (AND-split for WHERE/HAVING)."""
    sep = r"(?i)\s+and\s+" if name in ("where", "having") else ","
    return F.when(body.isNull(), F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(F.transform(F.split(body, sep), lambda x: F.lower(F.trim(x))),
                                  lambda x: x != "")))


def clauses(sql: Column) -> Column:
    """All clauses as a struct of strings."""
    return F.struct(*[clause(sql, n).alias(n) for n in CLAUSE_RE])
