"""L4 query-corpus operators as DataFrame jobs.

The reference runs these as per-string Python functions over a few hundred
records; here each is a column expression or a join/aggregate over a log of
any size.  Text rules live in ``fiscus.functions.sqltext``.

``query_log``: the driver supplies no SQL text, so the log is built from
``part`` by fixed templates (SURVEY 7.3): fenced / unfenced answers, ``==``
and ``!=`` typos, placeholders, wrong table names, double-quoted literals,
CTEs, GROUP BY / HAVING, nested SELECTs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions import sqltext as T
from fiscus.functions.blocks import _let as let
from fiscus.plans.star import CATALOG_TABLES
from fiscus.session import spread
from fiscus.sources.tables import Tables

col = F.col

# --------------------------------------------------------------------------
# Query-log templates, as SQL expressions over ``part`` valid in Spark SQL
# and in the oracle engine ({S} is the string type name of the engine).
# --------------------------------------------------------------------------
_NL = "chr(10)"
TEXT_TEMPLATES = [
    # 0 fenced ```sql answer with prose
    "'Here is the SQL:' || {nl} || '```sql' || {nl} || 'SELECT g.year, g.value FROM gfs_observations g "
    "JOIN countries c ON g.country_id = c.country_id WHERE c.country_name = ''' || p_brand || "
    "''' AND g.year = ' || CAST(1990 + p_size AS {S}) || ';' || {nl} || '```'",
    # 1 untagged fence, GROUP BY / HAVING
    "'```' || {nl} || 'SELECT c.country_name, COUNT(*) FROM countries c JOIN gem_observations g "
    "ON c.country_id = g.country_id GROUP BY c.country_name HAVING COUNT(*) > ' || CAST(p_size AS {S}) "
    "|| {nl} || '```'",
    # 2 typos == and != with trailing semicolon
    "'SELECT * FROM gem_observations WHERE value == ' || CAST(p_size AS {S}) || "
    "' AND indicator_id != ' || CAST(p_partkey AS {S}) || ';'",
    # 3 placeholder
    "'SELECT value FROM gfs_observations WHERE year = [YEAR] AND indicator_id = ' || CAST(p_partkey AS {S})",
    # 4 wrong table and column, double-quoted literal (with / without sector context)
    "CASE WHEN p_size % 2 = 0 THEN 'SELECT observation_value FROM observations o JOIN sectors s "
    "ON o.sector_id = s.sector_id WHERE s.sector_name = \"' || p_type || '\";' "
    "ELSE 'SELECT observation_value FROM observations WHERE unit = \"' || p_type || '\"' END",
    # 5 CTE, missing space after comma
    "'WITH t AS (SELECT year, SUM(value) AS total FROM gem_observations GROUP BY year) "
    "SELECT year,total FROM t WHERE total > ' || CAST(p_size AS {S}) || ' ORDER BY year'",
    # 6 prose prefix, join + group + order + limit
    "'The answer is SELECT i.indicator_name, AVG(g.value) FROM gfs_observations g JOIN indicators i "
    "ON g.indicator_id = i.indicator_id WHERE i.indicator_name = ''' || p_name || ''' AND g.year >= 1995 "
    "GROUP BY i.indicator_name ORDER BY 2 DESC LIMIT ' || CAST(p_size AS {S})",
    # 7 non-existent table, nested SELECT
    "'SELECT DISTINCT country_name FROM tax_revenue WHERE year IN (SELECT MAX(year) FROM gfs_observations) "
    "ORDER BY country_name'",
]
QUESTION_TEMPLATES = [
    "'Show total revenue for ' || p_name || ' by year'",
    "'What is the average expenditure of ' || p_brand || ' in the USA?'",
    "'Count GDP growth years with a deficit for ' || p_type",
    "'List the UK surplus per quarter for ' || p_name || ' ordered by rank'",
]


def _case(key: str, templates: Sequence[str], S: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {t.format(S=S, nl=_NL)}" for i, t in enumerate(templates))
    return f"CASE {key} {arms} END"


def query_log_exprs(S: str) -> dict[str, str]:
    return {
        "id": "p_partkey",
        "question": _case(f"p_partkey % {len(QUESTION_TEMPLATES)}", QUESTION_TEMPLATES, S),
        "text": _case(f"p_partkey % {len(TEXT_TEMPLATES)}", TEXT_TEMPLATES, S),
        "difficulty": "CASE p_size % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'hard' END",
        "category": "lower(p_type)",
    }


def query_log(t: Tables) -> DataFrame:
    """(id, question, text, difficulty, category): one model answer per part."""
    return t.part.selectExpr(*[f"{e} AS {n}" for n, e in query_log_exprs("STRING").items()])


def with_sql(log: DataFrame) -> DataFrame:
    return log.withColumn("sql", T.extract_sql(col("text")))


# ---------------------------------------------------------------- D-7 / A30
def refs_valid(sql: Column, tables: Sequence[str] = CATALOG_TABLES) -> Column:
    """Every FROM/JOIN name is a catalog table or a CTE of the statement.
    (The catalog is the schema's table list: a fixed, small array.)"""
    known = F.array(*[F.lit(x) for x in tables])
    unknown = F.array_except(F.array_except(T.table_refs(sql), T.cte_names(sql)), known)
    return F.size(unknown) == 0


def clean_status(log: DataFrame) -> DataFrame:
    """D-7: extract -> placeholders removed -> valid kept -> repaired and
    valid fixed -> else unfixable.  Adds ``clean_sql`` and ``status``."""
    sql = T.extract_from_assistant(col("text"))
    rep = T.repair_sql(col("_sql"))
    return (log.withColumn("_sql", sql).withColumn("_rep", rep)
            .withColumn("status",
                        F.when(T.has_placeholder(col("_sql")), "removed_placeholder")
                         .when(refs_valid(col("_sql")), "kept")
                         .when(col("_rep.was_fixed") & refs_valid(col("_rep.sql")), "fixed")
                         .otherwise("unfixable"))
            .withColumn("clean_sql", F.when(col("status") == "kept", col("_sql"))
                        .when(col("status") == "fixed", col("_rep.sql")))
            .drop("_sql", "_rep"))


# ---------------------------------------------------------------- D-11
# Domain synonym dictionary, applied term by term in this order.
SYNONYMS = [
    ("USA", ["United States", "America", "US"]),
    ("UK", ["United Kingdom", "Britain", "Great Britain"]),
    ("revenue", ["income", "earnings", "receipts"]),
    ("expenditure", ["spending", "expenses", "outlays"]),
    ("GDP", ["gross domestic product", "economic output"]),
    ("growth", ["increase", "expansion", "rise"]),
    ("deficit", ["shortfall", "gap", "negative balance"]),
    ("surplus", ["excess", "positive balance"]),
    ("year", ["annual", "yearly"]),
    ("quarter", ["quarterly", "Q1/Q2/Q3/Q4"]),
    ("total", ["aggregate", "sum", "combined"]),
    ("average", ["mean", "typical"]),
    ("show", ["display", "retrieve", "get"]),
    ("count", ["number of", "total number"]),
]


def synonym_augment(log: DataFrame, id_col: str = "id", text_col: str = "question") -> DataFrame:
    """D-11: whole-word, case-insensitive replacement term by term (each
    term sees the text produced by the previous ones).  The synonym choice
    is a deterministic function of (id, term position) instead of an
    unseeded random pick, so reruns and retried tasks agree.  Rows with no
    replacement are dropped.  ``replacements`` lists 'term->synonym' in
    dictionary order.

    Each term is a step over the text and the list so far, computed once a
    row (``let``): its pattern is a literal, compiled once a task.
    """
    q = col(text_col)
    acc = F.struct(q.alias("q"), F.array().cast("array<string>").alias("reps"))

    def step(i: int, term: str, syns: Sequence[str]):
        pat = r"(?i)\b" + term + r"\b"
        choice = F.get(F.array(*[F.lit(x) for x in syns]), F.pmod(col(id_col) + i, F.lit(len(syns))).cast("int"))

        def replaced(s: Column) -> Column:
            return let(choice, lambda c: F.struct(
                F.regexp_replace(s["q"], F.lit(pat), c).alias("q"),
                F.concat(s["reps"], F.array(F.concat(F.lit(term + "->"), c))).alias("reps")))

        return lambda s: F.when(F.regexp_like(s["q"], F.lit(pat)), replaced(s)).otherwise(s)

    for i, (term, syns) in enumerate(SYNONYMS):
        acc = let(acc, step(i, term, syns))
    # a generator, not a filter: a filter would be pushed below and compute the steps twice
    out = spread(log.select(id_col, text_col)).select(
        id_col, q.alias("_q"), F.explode(F.filter(F.array(acc), lambda a: F.size(a["reps"]) > 0)).alias("_acc"))
    return (out.select(col(id_col), col("_acc.q").alias("question"), col("_q").alias("original_question"),
                    F.lit("synonym").alias("augmentation_type"),
                    F.array_join("_acc.reps", ";").alias("replacements")))


# ---------------------------------------------------------------- D-12 / J11
def results_log(t: Tables) -> DataFrame:
    """Execution outcomes keyed by query id: one row per lineitem of the
    part (id), failure = returnflag 'R', ordered by (orderkey, linenumber)."""
    li = t.lineitem
    return li.select(col("l_partkey").alias("id"), "l_orderkey", "l_linenumber",
                     (col("l_returnflag") != "R").alias("correction_success"),
                     F.concat(F.lit("status "), col("l_linestatus"), F.lit(" on line "),
                              col("l_linenumber").cast("string")).alias("error"))


def failed_examples(log: DataFrame, results: DataFrame) -> DataFrame:
    """Queries with a failed result; the first failure's error.
    ``min_by`` keeps the join input at one row per id whatever the number of
    results per query."""
    first = (results.where(~col("correction_success")).groupBy("id")
             .agg(F.min_by("error", F.struct("l_orderkey", "l_linenumber")).alias("error")))
    return log.join(first, "id")


def hard_examples(log: DataFrame, results: DataFrame) -> DataFrame:
    """D-12: difficulty 'hard' (reason high_difficulty) plus model failures
    (reason model_failure, with the error as common_errors)."""
    by_diff = (log.where(col("difficulty") == "hard")
               .select("id", col("question").alias("original_question"),
                       F.lit("high_difficulty").alias("selection_reason"),
                       F.lit(None).cast("string").alias("common_error")))
    failed = (failed_examples(log, results)
              .select("id", col("question").alias("original_question"),
                      F.lit("model_failure").alias("selection_reason"),
                      col("error").alias("common_error")))
    return by_diff.unionByName(failed).withColumn("augmentation_type", F.lit("hard_example"))


# ---------------------------------------------------------------- D-14 / D-15
def column_refs(sqls: DataFrame, catalog: DataFrame, id_col: str = "id") -> DataFrame:
    """D-14: (id, table, column) for every word of the statement that names
    a column of any catalog table (qualified refs are a subset).  The catalog
    is a schema's column list (fixed and small): it is what the tasks get whole.
    Words look as small as the log's file to the planner, which would send them."""
    w = sqls.select(id_col, F.explode(T.words(col("sql"))).alias("column_name"))
    return w.join(F.broadcast(catalog.select("table_name", "column_name")), "column_name") \
            .select(id_col, "table_name", "column_name")


def table_ref_rows(sqls: DataFrame, id_col: str = "id") -> DataFrame:
    """D-13: (id, table) for catalog-verified FROM/JOIN references."""
    known = F.array(*[F.lit(x) for x in CATALOG_TABLES])
    return (sqls.select(id_col, F.explode(F.array_intersect(T.table_refs(col("sql")), known))
                        .alias("table_name")))


def pair_builder(sqls: DataFrame, catalog: DataFrame, ratio: int = 2) -> DataFrame:
    """D-15: label-1 pairs for used tables / columns, label-0 pairs for up to
    ``ratio`` x as many unused ones, chosen in name order: tables per
    question, columns per used table and by its own used columns.  A used
    column of a table that the statement does not name is still a label-1
    pair.  Joins by id have a row or more per question on both sides, so they
    are merge joins whatever the log's file measures."""
    used_t = table_ref_rows(sqls)
    n_pos = used_t.groupBy("id").agg(F.count(F.lit(1)).alias("n_pos"))
    all_t = sqls.select("id", F.explode(F.array(*[F.lit(x) for x in CATALOG_TABLES])).alias("table_name"))
    neg_t = (all_t.join(used_t.hint("merge"), ["id", "table_name"], "left_anti").join(n_pos.hint("merge"), "id")
             .withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("table_name")))
             .where(col("_rn") <= ratio * col("n_pos")))
    tables = (used_t.select("id", F.lit("table").alias("item_type"), col("table_name").alias("item"),
                            F.lit(1).alias("label"))
              .unionByName(neg_t.select("id", F.lit("table").alias("item_type"),
                                        col("table_name").alias("item"), F.lit(0).alias("label"))))
    used_c = column_refs(sqls, catalog)
    per_table = catalog.groupBy("table_name").agg(F.array_sort(F.collect_list("column_name")).alias("_all"))
    used_in = used_c.groupBy("id", "table_name").agg(F.collect_set("column_name").alias("_used"))
    neg_c = (used_t.join(used_in.hint("merge"), ["id", "table_name"]).join(F.broadcast(per_table), "table_name")
             .select("id", "table_name", F.explode(F.slice(F.array_except("_all", "_used"), F.lit(1),
                                                           ratio * F.size("_used"))).alias("column_name")))
    item = F.concat_ws(".", "table_name", "column_name")
    cols = (used_c.select("id", F.lit("column").alias("item_type"), item.alias("item"), F.lit(1).alias("label"))
            .unionByName(neg_c.select("id", F.lit("column").alias("item_type"), item.alias("item"),
                                      F.lit(0).alias("label"))))
    return tables.unionByName(cols)


# ---------------------------------------------------------------- D-17 / D-18
# System prompts and prompt wording of the four templates.
SYSTEM_PROMPTS = {
    "cot": "You are an expert SQL generator. Always think step-by-step before generating queries, explaining your reasoning clearly.",
    "synonym": "You are an expert SQL generator. Handle different phrasings and terminology variations of the same question effectively.",
    "skeleton": "You are an expert SQL generator. Focus on recognizing query patterns and structures to generate accurate SQL.",
    "hard": "You are an expert SQL generator specializing in complex queries. Pay careful attention to edge cases, multi-table relationships, and advanced SQL operations.",
}
COT_REQUEST = "First explain your reasoning step-by-step, then generate the SQL query."
PATTERN_LINES = ("Pattern Type: {0}\nInstructions: This query follows a {0} pattern. "
                 "Identify the required SQL components and generate accurate SQL.")


def schema_block(catalog: Sequence[tuple]) -> str:
    """The catalog as one line per table."""
    tables: dict[str, list[str]] = {}
    for table, column, *_ in catalog:
        tables.setdefault(table, []).append(column)
    return "\n".join(f"{t}({', '.join(cs)})" for t, cs in tables.items())


def chat_format(rows: DataFrame, schema_text: str) -> DataFrame:
    """D-17: chat records ``messages: array<struct<role, content>>``.

    ``template`` picks cot / synonym / skeleton / hard; cot reads
    ``reasoning``, skeleton ``pattern_type``, hard ``hint`` or else the list
    ``common_errors`` (both may be NULL: no extra block)."""
    kind = col("template")
    before, after = PATTERN_LINES.split("{0}", 1)
    pattern = F.concat(F.lit(before), col("pattern_type"), F.replace(F.lit(after), F.lit("{0}"), col("pattern_type")))
    errors = F.array_join(F.transform("common_errors", lambda e: F.concat(F.lit("- "), e)), "\n")
    more = (F.when(kind == "cot", COT_REQUEST).when(kind == "skeleton", pattern)
             .when(kind == "hard", F.coalesce(F.concat(F.lit("Hint: "), col("hint")),
                                              F.concat(F.lit("Common errors to avoid:\n"), errors))))
    user = F.concat_ws("\n\n", F.lit(f"Database Schema:\n{schema_text}"),
                       F.concat(F.lit("Question: "), col("question")), more)
    answer = F.concat_ws("\n\n", F.when(kind == "cot", col("reasoning")),
                         F.concat(F.lit("```sql\n"), col("sql"), F.lit("\n```")))
    system = F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_PROMPTS.items() for x in kv]), kind)
    said = [F.struct(F.lit(role).alias("role"), text.alias("content"))
            for role, text in (("system", system), ("user", user), ("assistant", answer))]
    return rows.select("id", "template", F.array(*said).alias("messages"))


def chat_validate(conversations: DataFrame) -> DataFrame:
    """D-18: per conversation, message count (valid = exactly 3) plus first /
    last role and empty-message count, as aggregates (no message list is
    collected)."""
    return (conversations.groupBy("conv_id")
            .agg(F.count(F.lit(1)).alias("n_messages"),
                 F.min_by("role", "turn").alias("first_role"),
                 F.max_by("role", "turn").alias("last_role"),
                 F.count_if(col("text").isNull() | (col("text") == "")).alias("empty_messages"))
            # reference rule: a record is valid when it has exactly 3 messages;
            # roles / empty messages are reported alongside, not enforced
            .withColumn("valid", col("n_messages") == 3))


# ---------------------------------------------------------------- W10 / D-35
def row_batches(rows: DataFrame, order_col: str, text_col: str, n: int) -> DataFrame:
    """Consecutive batches of ``n`` rows in ``order_col`` order, each
    rendered as a numbered list.  Row numbers are assigned without a global
    single-task window (see ``sorted_surrogate_key``); each group holds at
    most ``n`` rows by construction."""
    from fiscus.operators.ingest import sorted_surrogate_key
    numbered = (sorted_surrogate_key(rows.select(order_col, text_col), order_col, "_seq")
                .withColumnRenamed("_seq", "_rn"))
    b = numbered.withColumn("batch_id", F.floor((col("_rn") - 1) / n).cast("bigint"))
    items = F.array_sort(F.collect_list(F.struct(col("_rn"), col(text_col).alias("t"))))
    return (b.groupBy("batch_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.array_join(F.transform(items, lambda x: F.concat(
                     (x["_rn"] - col("batch_id") * n).cast("string"), F.lit(". "), x["t"])), "\n")
                 .alias("text")))


# ---------------------------------------------------------------- D-27 / D-28
# Guideline trigger -> keywords (trigger tested on the section
# text; table triggers case-insensitive, SQL keyword triggers case-sensitive).
KEYWORD_RULES = [
    ("gfs_observations", True, ["gfs", "government", "revenue", "expenditure", "tax"]),
    ("gem_observations", True, ["gem", "gdp", "economic", "indicator", "unemployment", "stock"]),
    ("DISTINCT", False, ["distinct"]),
    ("ORDER BY", False, ["order", "sort", "top", "rank"]),
    ("JOIN", False, ["join", "country", "sector", "indicator"]),
    ("LIKE", False, ["like", "match", "pattern", "start", "contain"]),
]
KEYWORD_VOCAB = sorted({k for _, _, ks in KEYWORD_RULES for k in ks})


def keyword_tags(text: Column) -> Column:
    """D-27: keywords of a section, in rule order, repeats kept."""
    parts = []
    for trig, ci, kws in KEYWORD_RULES:
        hit = F.lower(text).contains(trig.lower()) if ci else text.contains(trig)
        parts.append(F.when(hit, F.array(*[F.lit(k) for k in kws]))
                     .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def guideline_sections(sqls: DataFrame) -> DataFrame:
    """Guideline analog: one section per SQL pattern class, its body the
    first statement of that class; numbered in class-name order.  The
    section count is bounded by the number of pattern classes."""
    per = (sqls.groupBy(T.pattern_class(col("sql")).alias("pattern_type"))
           .agg(F.min_by("sql", "id").alias("body")))
    return per.withColumn("section_no", F.row_number().over(Window.orderBy("pattern_type")))


def select_sections(questions: DataFrame, sections: DataFrame, max_patterns: int = 5) -> DataFrame:
    """D-28: score = number of section keywords (with repeats) contained in
    the question; keep the top ``max_patterns`` sections with score > 0
    (ties by section number); a question with no match gets the first
    ``max_patterns`` sections.

    Matching is an equi-join on keyword: each question is reduced to the
    vocabulary words it contains (fixed vocabulary), each section to its
    keyword rows, so only matching (question, section) pairs are produced.
    """
    vocab = F.array(*[F.lit(k) for k in KEYWORD_VOCAB])
    q_kw = questions.select("id", F.explode(F.filter(vocab, lambda k: F.lower(col("question")).contains(k)))
                            .alias("keyword"))
    s_kw = sections.select("section_no", F.explode(keyword_tags(col("body"))).alias("keyword"))
    # s_kw: <= pattern classes x vocabulary rows (fixed bound)
    scored = (q_kw.join(F.broadcast(s_kw), "keyword")
              .groupBy("id", "section_no").agg(F.count(F.lit(1)).alias("score")))
    ranked = (scored.withColumn("rank", F.row_number().over(
        Window.partitionBy("id").orderBy(col("score").desc(), col("section_no"))))
        .where(col("rank") <= max_patterns))
    first = (sections.where(col("section_no") <= max_patterns)
             .agg(F.collect_list("section_no").alias("_first")))  # at most max_patterns values
    unmatched = questions.select("id").join(ranked.select("id").distinct(), "id", "left_anti")
    from fiscus.plans.analytics import attach_scalar
    fallback = (attach_scalar(unmatched, first)
                .select("id", F.explode(F.array_sort("_first")).alias("section_no"))
                .withColumn("score", F.lit(0).cast("bigint"))
                .withColumn("rank", col("section_no").cast("int")))
    return ranked.unionByName(fallback.select(*ranked.columns))


# ---------------------------------------------------------------- D-39
# Calibration weights and thresholds.
CALIBRATION = {"syntax": 0.3, "schema": 0.3, "value": 0.2, "structure": 0.2,
               "min_confidence": 0.5, "high_confidence": 0.8}


def weighted_score(sql: Column) -> Column:
    """D-39: weighted flags -> struct(score, confidence)."""
    syntax = sql.rlike(r"(?is)^\s*(SELECT|WITH)\s")
    schema = refs_valid(sql)
    value = ~T.has_placeholder(sql)
    opens = F.length(sql) - F.length(F.replace(sql, F.lit("("), F.lit("")))
    closes = F.length(sql) - F.length(F.replace(sql, F.lit(")"), F.lit("")))
    structure = (opens == closes) & sql.rlike(r"(?i)\bFROM\b")
    score = F.round(sum(F.when(f, w).otherwise(0.0) for f, w in [
        (syntax, CALIBRATION["syntax"]), (schema, CALIBRATION["schema"]),
        (value, CALIBRATION["value"]), (structure, CALIBRATION["structure"])]), 4)
    conf = (F.when(score >= CALIBRATION["high_confidence"], "high")
             .when(score >= CALIBRATION["min_confidence"], "accept").otherwise("reject"))
    return F.struct(score.alias("score"), conf.alias("confidence"))


# ---------------------------------------------------------------- D-34
def prompt_rows(sqls: DataFrame, catalog: DataFrame, max_patterns: int = 5) -> DataFrame:
    """D-34: prompt = linked schema + selected guideline sections + question."""
    tt = (catalog.groupBy("table_name")
          .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("_c"))  # schema width
          .select("table_name", F.concat(col("table_name"), F.lit("("), F.array_join(
              F.transform("_c", lambda x: x["column_name"]), ", "), F.lit(")")).alias("tt")))
    schema_part = (table_ref_rows(sqls).distinct().join(F.broadcast(tt), "table_name")
                   .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("table_name", "tt"))).alias("_t"))
                   .select("id", F.array_join(F.transform("_t", lambda x: x["tt"]), "\n").alias("schema_part")))
    sections = guideline_sections(sqls)
    sel = select_sections(sqls, sections, max_patterns)
    guide = (sel.join(sections.select("section_no", "body"), "section_no")
             .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("_g"))
             .select("id", F.array_join(F.transform("_g", lambda x: x["body"]), "\n\n").alias("guide")))
    nl = F.lit("\n")
    prompt = F.concat(F.lit("### Database schema"), nl, F.coalesce("schema_part", F.lit("")), nl, nl,
                      F.lit("### Guidelines"), nl, F.lit("Common SQL Mistakes to Avoid:"), nl, nl,
                      F.coalesce("guide", F.lit("")), nl, nl, F.lit("### Question"), nl, col("question"),
                      nl, nl, F.lit("### SQL"))
    return (sqls.select("id", "question").join(schema_part, "id", "left").join(guide, "id", "left")
            .select("id", prompt.alias("prompt")))


# ---------------------------------------------------------------- D-25
# Words that can follow a table name but are not aliases.
SQL_KEYWORDS = ("ON", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "GROUP", "ORDER",
                "LIMIT", "HAVING", "UNION", "SELECT", "AS", "USING", "NATURAL", "OUTER")


def ref_report(sqls: DataFrame, alias_re: str) -> DataFrame:
    """D-25: qualified references resolved through the statement's own
    FROM/JOIN aliases and checked against the schema catalog.

    Everything a row needs is in the row (its aliases and references) or in
    the fixed schema (inlined as literal arrays / a map), so the report is a
    single map-side projection: no shuffle, no join."""
    from fiscus.plans.star import STAR_CATALOG
    pairs = F.array(*[F.lit(f"{t}.{c}") for t, c, _, _ in STAR_CATALOG])
    first_table: dict[str, str] = {}
    for t, c, _, _ in sorted(STAR_CATALOG):
        first_table.setdefault(c, t)
    suggest = F.create_map(*[x for c, t in sorted(first_table.items()) for x in (F.lit(c), F.lit(t))])
    known = F.array(*[F.lit(x) for x in CATALOG_TABLES])
    refs = F.array_distinct(F.zip_with(
        F.regexp_extract_all("sql", F.lit(T.QUALIFIED_RE), 1),
        F.regexp_extract_all("sql", F.lit(T.QUALIFIED_RE), 2),
        lambda x, y: F.struct(x.alias("q"), y.alias("c"))))
    aliases = F.filter(F.zip_with(
        F.regexp_extract_all("sql", F.lit(alias_re), 1),
        F.regexp_extract_all("sql", F.lit(alias_re), 2),
        lambda x, y: F.struct(F.lower(x).alias("t"), F.lower(y).alias("a"))),
        lambda x: (x["a"] != "") & ~F.array_contains(F.array(*[F.lit(k) for k in SQL_KEYWORDS]), F.upper(x["a"])))
    rows = sqls.select("id", F.explode(refs).alias("r"), aliases.alias("_al"))
    qual = F.lower(col("r.q"))
    via_alias = F.array_min(F.transform(F.filter("_al", lambda x: x["a"] == qual), lambda x: x["t"]))
    resolved = F.coalesce(via_alias, F.when(F.array_contains(known, qual), qual))
    valid = F.coalesce(F.array_contains(pairs, F.concat(resolved, F.lit("."), F.lower(col("r.c")))), F.lit(False))
    return rows.select("id", col("r.q").alias("qualifier"), col("r.c").alias("column_name"),
                       resolved.alias("resolved_table"), valid.alias("valid"),
                       F.when(~valid, F.element_at(suggest, F.lower(col("r.c")))).alias("suggested_table"))


# ---------------------------------------------------------------- D-26
# Fixed value: the guideline section heading.
SECTION_HEADING = r"# (\d+)\. Reminder of mistake"


def split_sections(text: Column, heading: str = SECTION_HEADING) -> Column:
    """D-26: text -> array<struct<section_no int, body string>>.  Each body
    is the heading followed by its content, stripped; text before the first
    heading is dropped (it is the guideline's introduction)."""
    heads = F.regexp_extract_all(text, F.lit(heading), 0)
    nums = F.regexp_extract_all(text, F.lit(heading), 1)
    bodies = F.slice(F.split(text, heading), 2, F.size(nums))
    return F.zip_with(
        F.zip_with(heads, nums, lambda h, n: F.struct(h.alias("h"), n.alias("n"))), bodies,
        lambda hn, b: F.struct(hn["n"].cast("int").alias("section_no"),
                               T.strip_ws(F.concat(hn["h"], b)).alias("body")))
