"""Registered corpus plans (D-1 .. D-39 over the derived query log) with
their oracle statements.  ``D`` helpers below spell the same text rules in
the oracle's SQL dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscus.functions import sqltext as T
from fiscus.operators import corpus as C
from fiscus.plans import analytics as A
from fiscus.plans.registry import register
from fiscus.plans.star import CATALOG_TABLES, STAR_CATALOG, catalog_frame, catalog_sql
from fiscus.sources.tables import Tables

col = F.col


# ------------------------------------------------------------- oracle helpers
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(r'^\s+|\s+\z')}, '', 'g')"


def d_extract_sql(x: str) -> str:
    a, b = q(T.FENCE_SQL_RE), q(T.FENCE_ANY_RE)
    return (f"CASE WHEN regexp_matches({x}, {a}) THEN {d_strip(f'regexp_extract({x}, {a}, 1)')} "
            f"WHEN regexp_matches({x}, {b}) THEN {d_strip(f'regexp_extract({x}, {b}, 1)')} "
            f"ELSE {d_strip(x)} END")


def d_extract_assistant(x: str) -> str:
    a, b = q(r"(?s)```sql\s+(.*?)\s+```"), q(r"(?is)(SELECT\s+.*)")
    return (f"CASE WHEN regexp_matches({x}, {a}) THEN {d_strip(f'regexp_extract({x}, {a}, 1)')} "
            f"WHEN regexp_matches({x}, {b}) THEN {d_strip(f'regexp_extract({x}, {b}, 1)')} "
            f"ELSE {d_strip(x)} END")


def d_placeholder(x: str) -> str:
    return f"regexp_matches({x}, {q(T.PLACEHOLDER_RE)})"


def d_table_refs(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(T.TABLE_REF_RE)}, 1), lambda r: lower(r))"


def d_cte_names(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(T.CTE_NAME_RE)}, 1), lambda r: lower(r))"


KNOWN = "[" + ", ".join(q(t) for t in CATALOG_TABLES) + "]"


def d_refs_valid(x: str) -> str:
    return (f"len(list_filter({d_table_refs(x)}, lambda r: NOT list_contains({d_cte_names(x)}, r) "
            f"AND NOT list_contains({KNOWN}, r))) = 0")


QL_SQL = "ql AS (SELECT " + ", ".join(
    f"{e} AS {n}" for n, e in C.query_log_exprs("VARCHAR").items()) + " FROM part)"
EX_SQL = f"ex AS (SELECT *, {d_extract_sql('text')} AS sql FROM ql)"


def with_ql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([QL_SQL, EX_SQL, *ctes]) + "\n" + body


def _log(spark, sf):
    return C.query_log(Tables(spark, sf))


# ---------------------------------------------------------------- D-1
@register("extract_sql", with_ql("SELECT id, sql FROM ex"))
def extract_sql(spark, sf):
    return C.with_sql(_log(spark, sf)).select("id", "sql")


# ---------------------------------------------------------------- O9
@register("first_n_sample", with_ql("SELECT id, question FROM ql ORDER BY id LIMIT 100"))
def first_n_sample(spark, sf):
    """The first 100 questions of the ordered log: the sample is the feature."""
    return A.top_n(_log(spark, sf).select("id", "question"), 100, [F.col("id")])


# ---------------------------------------------------------------- D-2
_t2 = ("regexp_replace(regexp_replace(text, " + q(r"```sql\s*") + ", '', 'g'), "
       + q(r"```\s*") + ", '', 'g')")


@register("extract_sql_select", with_ql(f"""
SELECT id, CASE WHEN regexp_matches(t, {q(T.WITH_OR_SELECT_RE)})
                THEN {d_strip(f"regexp_extract(t, {q(T.WITH_OR_SELECT_RE)}, 1)")}
                ELSE {d_strip('t')} END AS sql
FROM (SELECT id, {_t2} AS t FROM ql) s"""))
def extract_sql_select(spark, sf):
    return _log(spark, sf).select("id", T.extract_sql_select(col("text")).alias("sql"))


# ---------------------------------------------------------------- D-4
@register("normalize_sql", with_ql(
    "SELECT id, " + d_strip(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '==', '=', 'g'), '!=', '<>', 'g'), "
        + q(r",([^\s])") + ", " + q(r", \1") + ", 'g'), " + q(r"\s+") + ", ' ', 'g')")
    + " AS sql_normalized FROM ex"))
def normalize_sql(spark, sf):
    return C.with_sql(_log(spark, sf)).select("id", T.normalize_sql(col("sql")).alias("sql_normalized"))


# ---------------------------------------------------------------- D-5
@register("placeholder_flag", with_ql(f"SELECT id, {d_placeholder('sql')} AS has_placeholder FROM ex"))
def placeholder_flag(spark, sf):
    return C.with_sql(_log(spark, sf)).select("id", T.has_placeholder(col("sql")).alias("has_placeholder"))


# ---------------------------------------------------------------- D-6
REPAIR_CTES = [
    f"r1 AS (SELECT id, sql, regexp_replace(sql, {q(r'(?i)\bobservation_value\b')}, 'value', 'g') AS s FROM ex)",
    f"""r2 AS (SELECT id, sql, CASE WHEN regexp_matches(s, {q(r'(?i)\bFROM\s+observations\b')}) THEN
         CASE WHEN contains(lower(s), 'sector') THEN regexp_replace(s, {q(r'(?i)\bobservations\b')}, 'gfs_observations', 'g')
              ELSE regexp_replace(s, {q(r'(?i)\bobservations\b')}, 'gem_observations', 'g') END
         ELSE s END AS s FROM r1)""",
    f"r3 AS (SELECT id, sql, regexp_replace(s, {q(r'(?i)\bFROM\s+tax_revenue\b')}, 'FROM gfs_observations', 'g') AS s FROM r2)",
    f"""r4 AS (SELECT id, sql, regexp_replace(s, {q(r'(\w+)\s*=\s*"([^"]+)"')}, {q(r"\1 = '\2'")}, 'g') AS s FROM r3)""",
    f"r5 AS (SELECT id, sql, {d_strip(f'regexp_replace(s, {q(r';+\z')}, {q('')}, {q('g')})')} AS s FROM r4)",
]


@register("repair_sql", with_ql("SELECT id, s AS sql, s <> sql AS was_fixed FROM r5", *REPAIR_CTES))
def repair_sql(spark, sf):
    r = T.repair_sql(col("sql"))
    return C.with_sql(_log(spark, sf)).select("id", r["sql"].alias("sql"), r["was_fixed"].alias("was_fixed"))


# ---------------------------------------------------------------- D-7 / A30
_a_ctes = [
    f"a0 AS (SELECT id, {d_extract_assistant('text')} AS sql FROM ql)",
    *[c.replace("FROM ex)", "FROM a0)") for c in REPAIR_CTES],
    f"""st AS (SELECT r5.id, CASE WHEN {d_placeholder('r5.sql')} THEN 'removed_placeholder'
                          WHEN {d_refs_valid('r5.sql')} THEN 'kept'
                          WHEN r5.s <> r5.sql AND {d_refs_valid('r5.s')} THEN 'fixed'
                          ELSE 'unfixable' END AS status FROM r5)""",
]


@register("clean_query_log", with_ql(
    "SELECT status, CAST(COUNT(*) AS BIGINT) AS n FROM st GROUP BY status", *_a_ctes))
def clean_query_log(spark, sf):
    return C.clean_status(_log(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- D-8
def _d_skeleton(x: str) -> str:
    s = f"regexp_replace({x}, {q(r"'[^']*'")}, '[STRING]', 'g')"
    s = f"regexp_replace({s}, {q(r'\b\d+\b')}, '[NUMBER]', 'g')"
    for name, tag in T.SKELETON_COLUMNS:
        s = f"regexp_replace({s}, {q(r'(?i)\b' + name + r'\b')}, {q(tag)}, 'g')"
    return s


@register("sql_skeleton", with_ql(f"SELECT id, {_d_skeleton('sql')} AS skeleton FROM ex"))
def sql_skeleton(spark, sf):
    return C.with_sql(_log(spark, sf)).select("id", T.sql_skeleton(col("sql")).alias("skeleton"))


# ---------------------------------------------------------------- D-9
def _d_pattern(x: str) -> str:
    u = f"upper({x})"
    agg = " OR ".join(f"contains({u}, '{a}')" for a in ("SUM(", "AVG(", "COUNT(", "MAX(", "MIN("))
    return f"""CASE WHEN (length({u}) - length(replace({u}, 'SELECT', ''))) // 6 > 1 THEN 'nested_query'
       WHEN contains({u}, 'JOIN') AND contains({u}, 'GROUP BY') THEN 'multi_table_aggregation'
       WHEN contains({u}, 'JOIN') THEN 'multi_table_join'
       WHEN contains({u}, 'GROUP BY') AND contains({u}, 'HAVING') THEN 'filtered_aggregation'
       WHEN contains({u}, 'GROUP BY') THEN 'grouped_aggregation'
       WHEN {agg} THEN 'simple_aggregation'
       WHEN contains({u}, 'ORDER BY') THEN 'sorted_retrieval'
       ELSE 'simple_select' END"""


@register("pattern_class", with_ql(f"SELECT id, {_d_pattern('sql')} AS pattern_type FROM ex"))
def pattern_class(spark, sf):
    return C.with_sql(_log(spark, sf)).select("id", T.pattern_class(col("sql")).alias("pattern_type"))


# ---------------------------------------------------------------- D-10
@register("skeleton_topn", with_ql(f"""
SELECT skeleton, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT {_d_skeleton('sql')} AS skeleton FROM ex) s
GROUP BY skeleton ORDER BY n DESC, skeleton LIMIT 10"""))
def skeleton_topn(spark, sf):
    s = C.with_sql(_log(spark, sf)).select(T.sql_skeleton(col("sql")).alias("skeleton"))
    return (s.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(col("n").desc(), col("skeleton")).limit(10))


# ---------------------------------------------------------------- D-11
def _synonym_sql() -> str:
    ctes = ["s0 AS (SELECT id, question AS q0, question AS q, [] :: VARCHAR[] AS reps FROM ql)"]
    for i, (term, syns) in enumerate(C.SYNONYMS):
        pat = q(r"(?i)\b" + term + r"\b")
        arr = "[" + ", ".join(q(s) for s in syns) + "]"
        choice = f"{arr}[((id + {i}) % {len(syns)}) + 1]"
        ctes.append(
            f"s{i + 1} AS (SELECT id, q0, CASE WHEN regexp_matches(q, {pat}) "
            f"THEN regexp_replace(q, {pat}, {choice}, 'g') ELSE q END AS q, "
            f"CASE WHEN regexp_matches(q, {pat}) THEN list_append(reps, {q(term + '->')} || {choice}) "
            f"ELSE reps END AS reps FROM s{i})")
    n = len(C.SYNONYMS)
    return with_ql(f"""SELECT id, q AS question, q0 AS original_question, 'synonym' AS augmentation_type,
       array_to_string(reps, ';') AS replacements FROM s{n} WHERE len(reps) > 0""", *ctes)


@register("synonym_augment", _synonym_sql())
def synonym_augment(spark, sf):
    return C.synonym_augment(_log(spark, sf))


# ---------------------------------------------------------------- J11 / D-12
RESULTS_CTE = """res AS (
  SELECT l_partkey AS id, l_orderkey, l_linenumber, l_returnflag <> 'R' AS correction_success,
         'status ' || l_linestatus || ' on line ' || CAST(l_linenumber AS VARCHAR) AS error
  FROM lineitem)"""
FIRST_FAIL = """ff AS (
  SELECT id, error FROM (
    SELECT id, error, row_number() OVER (PARTITION BY id ORDER BY l_orderkey, l_linenumber) AS rn
    FROM res WHERE NOT correction_success) x WHERE rn = 1)"""


@register("failed_example_join", with_ql(
    "SELECT ql.id, ql.question, ff.error FROM ql JOIN ff ON ql.id = ff.id", RESULTS_CTE, FIRST_FAIL))
def failed_example_join(spark, sf):
    t = Tables(spark, sf)
    return C.failed_examples(C.query_log(t), C.results_log(t)).select("id", "question", "error")


@register("hard_examples", with_ql("""
SELECT id, question AS original_question, 'high_difficulty' AS selection_reason,
       CAST(NULL AS VARCHAR) AS common_error, 'hard_example' AS augmentation_type
FROM ql WHERE difficulty = 'hard'
UNION ALL
SELECT ql.id, ql.question, 'model_failure', ff.error, 'hard_example' FROM ql JOIN ff ON ql.id = ff.id""",
                                   RESULTS_CTE, FIRST_FAIL))
def hard_examples(spark, sf):
    t = Tables(spark, sf)
    return C.hard_examples(C.query_log(t), C.results_log(t))


# ---------------------------------------------------------------- D-13
@register("sql_table_refs", with_ql(f"""
SELECT DISTINCT id, t AS table_name FROM (SELECT id, unnest({d_table_refs('sql')}) AS t FROM ex) x
WHERE list_contains({KNOWN}, t)"""))
def sql_table_refs(spark, sf):
    return C.table_ref_rows(C.with_sql(_log(spark, sf)))


# ---------------------------------------------------------------- D-14
@register("sql_column_refs", with_ql(f"""
SELECT DISTINCT w.id, c.table_name, c.column_name
FROM (SELECT id, unnest(list_transform(regexp_extract_all(sql, {q(T.WORD_RE)}, 1), lambda r: lower(r))) AS word
      FROM ex) w
JOIN catalog c ON c.column_name = w.word""", catalog_sql()))
def sql_column_refs(spark, sf):
    return C.column_refs(C.with_sql(_log(spark, sf)), catalog_frame(spark))


# ---------------------------------------------------------------- D-15
_PAIR_CTES = [
    catalog_sql(),
    f"""ut AS (SELECT DISTINCT id, t AS table_name FROM (SELECT id, unnest({d_table_refs('sql')}) AS t FROM ex) x
             WHERE list_contains({KNOWN}, t))""",
    "np AS (SELECT id, COUNT(*) AS n_pos FROM ut GROUP BY id)",
    f"""nt AS (SELECT id, table_name FROM (
           SELECT a.id, a.table_name, row_number() OVER (PARTITION BY a.id ORDER BY a.table_name) AS rn, np.n_pos
           FROM (SELECT id, unnest({KNOWN}) AS table_name FROM ex) a JOIN np ON a.id = np.id
           WHERE NOT EXISTS (SELECT 1 FROM ut WHERE ut.id = a.id AND ut.table_name = a.table_name)) z
         WHERE rn <= 2 * n_pos)""",
    f"""uc AS (SELECT DISTINCT w.id, c.table_name, c.column_name
         FROM (SELECT id, unnest(list_transform(regexp_extract_all(sql, {q(T.WORD_RE)}, 1), lambda r: lower(r))) AS word
               FROM ex) w
         JOIN catalog c ON c.column_name = w.word)""",
    """nc AS (SELECT id, table_name, column_name FROM (
           SELECT ut.id, c.table_name, c.column_name, u.column_name IS NOT NULL AS used,
                  COUNT(u.column_name) OVER (PARTITION BY ut.id, c.table_name) AS n_used,
                  row_number() OVER (PARTITION BY ut.id, c.table_name, u.column_name IS NOT NULL
                                     ORDER BY c.column_name) AS place
           FROM ut JOIN catalog c USING (table_name)
           LEFT JOIN uc u ON u.id = ut.id AND u.table_name = c.table_name AND u.column_name = c.column_name) z
         WHERE NOT used AND place <= 2 * n_used)""",
]


_PAIRS_SQL = """
SELECT id, 'table' AS item_type, table_name AS item, 1 AS label FROM ut
UNION ALL SELECT id, 'table', table_name, 0 FROM nt
UNION ALL SELECT id, 'column', table_name || '.' || column_name, 1 FROM uc
UNION ALL SELECT id, 'column', table_name || '.' || column_name, 0 FROM nc"""


@register("pair_builder", with_ql(_PAIRS_SQL, *_PAIR_CTES))
def pair_builder(spark, sf):
    return C.pair_builder(C.with_sql(_log(spark, sf)), catalog_frame(spark))


# ---------------------------------------------------------------- D-16
#: first three hex digits of an MD5 under this value: 410 / 4096, a tenth
SPLIT_BELOW = "19a"


@register("hash_split", with_ql(f"""
SELECT id, item_type, item, label,
       IF(left(md5(concat_ws('|', id, item_type, item)), 3) < '{SPLIT_BELOW}', 'validation', 'train') AS split
FROM ({_PAIRS_SQL}) p""", *_PAIR_CTES))
def hash_split(spark, sf):
    """90/10 split of the training pairs by a hash of the pair: the same for
    every rerun, partitioning and retried task."""
    key = F.md5(F.concat_ws("|", col("id").cast("string"), "item_type", "item"))
    return pair_builder(spark, sf).withColumn(
        "split", F.when(F.substring(key, 1, 3) < SPLIT_BELOW, "validation").otherwise("train"))


# ---------------------------------------------------------------- D-17
_SCHEMA = C.schema_block(STAR_CATALOG)
_ERRORS = ("missing join condition", "wrong year filter")


def _chat_sql() -> str:
    nl = "chr(10)"
    system = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.SYSTEM_PROMPTS.items())
    lines = C.PATTERN_LINES.replace("\n", "' || chr(10) || '").replace("{0}", "' || pattern_type || '")
    errors = f" || {nl} || ".join(q(f"- {e}") for e in _ERRORS)
    return with_ql(f"""
SELECT id, template, 3 AS n_messages, CASE template {system} END AS system_content,
       {q("Database Schema:")} || {nl} || {f" || {nl} || ".join(q(x) for x in _SCHEMA.splitlines())}
         || {nl} || {nl} || 'Question: ' || question
         || CASE template WHEN 'cot' THEN {nl} || {nl} || {q(C.COT_REQUEST)}
                          WHEN 'skeleton' THEN {nl} || {nl} || '{lines}'
                          WHEN 'hard' THEN {nl} || {nl} || CASE WHEN id % 2 = 0 THEN 'Hint: check joins and filters'
                               ELSE 'Common errors to avoid:' || {nl} || {errors} END
                          ELSE '' END AS user_content,
       CASE WHEN template = 'cot' THEN 'Pattern: ' || pattern_type || {nl} || {nl} ELSE '' END
         || '```sql' || {nl} || sql || {nl} || '```' AS assistant_content
FROM (SELECT *, CASE WHEN difficulty = 'hard' THEN 'hard' WHEN pattern_type = 'nested_query' THEN 'cot'
                     WHEN difficulty = 'medium' THEN 'skeleton' ELSE 'synonym' END AS template
      FROM (SELECT *, {_d_pattern('sql')} AS pattern_type FROM ex) a) b""")


@register("chat_format", _chat_sql())
def chat_format(spark, sf):
    """Analog: reasoning names the pattern; even hard ids carry a hint, odd
    ones a list of errors."""
    ident, pattern = col("id"), T.pattern_class(col("sql"))
    rows = C.with_sql(_log(spark, sf)).withColumn("pattern_type", pattern)
    rows = rows.select(
        "*", F.concat(F.lit("Pattern: "), col("pattern_type")).alias("reasoning"),
        F.when(ident % 2 == 0, "check joins and filters").alias("hint"),
        F.array(*[F.lit(e) for e in _ERRORS]).alias("common_errors"),
        F.when(col("difficulty") == "hard", "hard").when(col("pattern_type") == "nested_query", "cot")
         .when(col("difficulty") == "medium", "skeleton").otherwise("synonym").alias("template"))
    m = C.chat_format(rows, _SCHEMA)
    return m.select("id", "template", F.size("messages").alias("n_messages"),
                    col("messages")[0]["content"].alias("system_content"),
                    col("messages")[1]["content"].alias("user_content"),
                    col("messages")[2]["content"].alias("assistant_content"))


# ---------------------------------------------------------------- D-18
@register("chat_validate", """
SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_messages, arg_min(role, turn) AS first_role,
       arg_max(role, turn) AS last_role,
       CAST(COUNT(*) FILTER (WHERE text IS NULL OR text = '') AS BIGINT) AS empty_messages,
       COUNT(*) = 3 AS valid
FROM conversations GROUP BY conv_id""")
def chat_validate(spark, sf):
    return C.chat_validate(Tables(spark, sf).conversations)


# ---------------------------------------------------------------- D-19
def _d_clause(x: str, name: str) -> str:
    return f"nullif({d_strip(f'regexp_extract({x}, {q(T.CLAUSE_RE[name])}, 1)')}, '')"


_NORM = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '==', '=', 'g'), '!=', '<>', 'g'), "
         + q(r",([^\s])") + ", " + q(r", \1") + ", 'g'), " + q(r"\s+") + ", ' ', 'g')")


@register("sql_clauses", with_ql(
    "SELECT id, " + ", ".join(f"{_d_clause('n', c)} AS {c}_clause" for c in T.CLAUSE_RE)
    + f" FROM (SELECT id, {d_strip(_NORM)} AS n FROM ex) x"))
def sql_clauses(spark, sf):
    n = T.normalize_sql(col("sql"))
    return C.with_sql(_log(spark, sf)).select(
        "id", *[T.clause(n, c).alias(f"{c}_clause") for c in T.CLAUSE_RE])


# ---------------------------------------------------------------- D-36
EXPECTED = ("SELECT", "FROM", "WHERE")


@register("expected_elements", with_ql(f"""
SELECT id, {" AND ".join(f"contains(lower(sql), {q(e.lower())})" for e in EXPECTED)} AS all_present,
       CAST({" + ".join(f"CASE WHEN contains(lower(sql), {q(e.lower())}) THEN 0 ELSE 1 END" for e in EXPECTED)}
            AS INTEGER) AS n_missing
FROM ex"""))
def expected_elements(spark, sf):
    exp = F.array(*[F.lit(e) for e in EXPECTED])
    low = F.lower(col("sql"))
    return C.with_sql(_log(spark, sf)).select(
        "id", F.forall(exp, lambda x: low.contains(F.lower(x))).alias("all_present"),
        F.size(F.filter(exp, lambda x: ~low.contains(F.lower(x)))).alias("n_missing"))


# ---------------------------------------------------------------- D-26
@register("section_split", """
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, body
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
             generate_subscripts(string_split(text, chr(10)), 1) AS section_no FROM documents) s""")
def section_split(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).select(
        "doc_id", (col("pos") + 1).alias("section_no"), "body")


# Analog guidelines: one per conversation (a few turns), each turn a section.
_GUIDE = "'Introduction' || chr(10) || string_agg('# ' || turn || '. Reminder of mistake' || chr(10) || text, chr(10) ORDER BY turn)"


def guidelines(t: Tables):
    turn = F.struct("turn", F.concat(F.lit("# "), col("turn").cast("string"), F.lit(". Reminder of mistake\n"),
                                     col("text")).alias("s"))
    parts = F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["s"])
    return (t.conversations.where("text IS NOT NULL").groupBy("conv_id")
            .agg(F.concat(F.lit("Introduction\n"), F.array_join(parts, "\n")).alias("guideline")))


@register("guideline_sections", f"""
SELECT conv_id, CAST(turn AS INTEGER) AS section_no,
       {d_strip("'# ' || turn || '. Reminder of mistake' || chr(10) || text")} AS body
FROM conversations WHERE text IS NOT NULL""")
def guideline_sections(spark, sf):
    g = guidelines(Tables(spark, sf))
    return (g.select("conv_id", F.explode(C.split_sections(col("guideline"))).alias("s"))
            .select("conv_id", "s.section_no", "s.body"))


# ---------------------------------------------------------------- A32
@register("guideline_stats", f"""
SELECT conv_id, COUNT(*) AS total_patterns, CAST(length({_GUIDE}) AS BIGINT) AS total_chars,
       CAST(length({_GUIDE}) // COUNT(*) AS BIGINT) AS avg_pattern_chars
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def guideline_stats(spark, sf):
    g = guidelines(Tables(spark, sf))
    n, chars = F.size(C.split_sections(col("guideline"))), F.length("guideline")
    return g.select("conv_id", n.cast("bigint").alias("total_patterns"), chars.cast("bigint").alias("total_chars"),
                    F.floor(chars / F.greatest(n, F.lit(1))).cast("bigint").alias("avg_pattern_chars"))


# ---------------------------------------------------------------- D-27
def _d_tags(x: str) -> str:
    parts = []
    for trig, ci, kws in C.KEYWORD_RULES:
        hit = f"contains(lower({x}), {q(trig.lower())})" if ci else f"contains({x}, {q(trig)})"
        arr = "[" + ", ".join(q(k) for k in kws) + "]"
        parts.append(f"CASE WHEN {hit} THEN {arr} ELSE [] :: VARCHAR[] END")
    return "flatten([" + ", ".join(parts) + "])"


@register("keyword_tags", with_ql(f"""
SELECT id, CAST(generate_subscripts(k, 1) AS INTEGER) AS pos, unnest(k) AS keyword
FROM (SELECT id, {_d_tags('sql')} AS k FROM ex) s"""))
def keyword_tags(spark, sf):
    s = C.with_sql(_log(spark, sf))
    return s.select("id", F.posexplode(C.keyword_tags(col("sql"))).alias("pos", "keyword")).select(
        "id", (col("pos") + 1).alias("pos"), "keyword")


# ---------------------------------------------------------------- D-28 / O10
_VOCAB = "[" + ", ".join(q(k) for k in C.KEYWORD_VOCAB) + "]"


_SEL_BODY = """
SELECT id, CAST(section_no AS INTEGER) AS section_no, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 5
UNION ALL
SELECT q.id, s.section_no, 0, s.section_no FROM ql q CROSS JOIN sec s
WHERE s.section_no <= 5 AND q.id NOT IN (SELECT id FROM ranked)"""
_SEL_CTES = [
    f"""sec AS (SELECT CAST(row_number() OVER (ORDER BY pattern_type) AS INTEGER) AS section_no, body FROM (
          SELECT {_d_pattern('sql')} AS pattern_type, arg_min(sql, id) AS body FROM ex GROUP BY 1) p)""",
    f"skw AS (SELECT section_no, unnest({_d_tags('body')}) AS keyword FROM sec)",
    f"qkw AS (SELECT id, unnest(list_filter({_VOCAB}, lambda k: contains(lower(question), k))) AS keyword FROM ql)",
    """sc AS (SELECT qkw.id, skw.section_no, COUNT(*) AS score FROM qkw JOIN skw ON qkw.keyword = skw.keyword
            GROUP BY qkw.id, skw.section_no)""",
    """ranked AS (SELECT id, section_no, score,
                  row_number() OVER (PARTITION BY id ORDER BY score DESC, section_no) AS rank FROM sc)""",
]


@register("keyword_topn_fallback", with_ql(_SEL_BODY, *_SEL_CTES))
def keyword_topn_fallback(spark, sf):
    s = C.with_sql(_log(spark, sf))
    return C.select_sections(s, C.guideline_sections(s), 5)


# ---------------------------------------------------------------- W10 / D-35
@register("row_batches", with_ql("""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(COUNT(*) AS BIGINT) AS n,
       string_agg(CAST(rn - batch_id * 10 AS VARCHAR) || '. ' || question, chr(10) ORDER BY rn) AS text
FROM (SELECT question, rn, (rn - 1) // 10 AS batch_id
      FROM (SELECT question, row_number() OVER (ORDER BY id) AS rn FROM ql) a) b
GROUP BY batch_id"""))
def row_batches(spark, sf):
    return C.row_batches(_log(spark, sf), "id", "question", 10).select("batch_id", "n", "text")


# ---------------------------------------------------------------- D-39
def _d_weighted(x: str) -> str:
    syntax = f"regexp_matches({x}, {q(r'(?is)^\s*(SELECT|WITH)\s')})"
    value = f"NOT {d_placeholder(x)}"
    structure = (f"(length({x}) - length(replace({x}, '(', ''))) = (length({x}) - length(replace({x}, ')', ''))) "
                 f"AND regexp_matches({x}, {q(r'(?i)\bFROM\b')})")
    w = C.CALIBRATION
    return (f"ROUND(CASE WHEN {syntax} THEN {w['syntax']} ELSE 0.0 END + CASE WHEN {d_refs_valid(x)} "
            f"THEN {w['schema']} ELSE 0.0 END + CASE WHEN {value} THEN {w['value']} ELSE 0.0 END + "
            f"CASE WHEN {structure} THEN {w['structure']} ELSE 0.0 END, 4)")


@register("weighted_score", with_ql(f"""
SELECT id, CAST(score AS DOUBLE) AS score,
       CASE WHEN score >= {C.CALIBRATION['high_confidence']} THEN 'high'
            WHEN score >= {C.CALIBRATION['min_confidence']} THEN 'accept' ELSE 'reject' END AS confidence
FROM (SELECT id, {_d_weighted('sql')} AS score FROM ex) s"""))
def weighted_score(spark, sf):
    w = C.weighted_score(col("sql"))
    return C.with_sql(_log(spark, sf)).select("id", w["score"].alias("score"), w["confidence"].alias("confidence"))


# ---------------------------------------------------------------- D-34
@register("prompt_rows", with_ql("""
SELECT ql.id, '### Database schema' || chr(10) || COALESCE(sc.schema_part, '') || chr(10) || chr(10) ||
       '### Guidelines' || chr(10) || 'Common SQL Mistakes to Avoid:' || chr(10) || chr(10) ||
       COALESCE(g.guide, '') || chr(10) || chr(10) || '### Question' || chr(10) || ql.question ||
       chr(10) || chr(10) || '### SQL' AS prompt
FROM ql
LEFT JOIN (SELECT id, string_agg(tt, chr(10) ORDER BY table_name) AS schema_part
           FROM (SELECT DISTINCT ut.id, ut.table_name, tt.tt FROM ut JOIN tt ON ut.table_name = tt.table_name) x
           GROUP BY id) sc ON ql.id = sc.id
LEFT JOIN (SELECT sel.id, string_agg(sec.body, chr(10) || chr(10) ORDER BY sel.rank) AS guide
           FROM sel JOIN sec ON sel.section_no = sec.section_no GROUP BY sel.id) g ON ql.id = g.id""",
    catalog_sql(),
    f"""ut AS (SELECT DISTINCT id, t AS table_name FROM (SELECT id, unnest({d_table_refs('sql')}) AS t FROM ex) x
             WHERE list_contains({KNOWN}, t))""",
    """tt AS (SELECT table_name, table_name || '(' || string_agg(column_name, ', ' ORDER BY ordinal) || ')' AS tt
            FROM catalog GROUP BY table_name)""",
    *_SEL_CTES,
    "sel AS (" + _SEL_BODY + ")"))
def prompt_rows(spark, sf):
    """D-34: prompt text per question = linked schema (referenced catalog
    tables with their columns) + selected guideline sections (D-28) +
    question.  Every per-question list is bounded (catalog tables, 5
    sections)."""
    s = C.with_sql(_log(spark, sf))
    return C.prompt_rows(s, catalog_frame(spark))


# ---------------------------------------------------------------- D-25
ALIAS_RE = r"(?i)(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)(?:\s+(?:AS\s+)?([a-zA-Z_][a-zA-Z0-9_]*))?"
_NOT_ALIAS = "[" + ", ".join(q(k) for k in C.SQL_KEYWORDS) + "]"


@register("ref_report", with_ql("""
SELECT r.id, r.qualifier, r.column_name, res.resolved_table,
       (c.column_name IS NOT NULL) AS valid, CASE WHEN c.column_name IS NULL THEN sg.suggested_table END AS suggested_table
FROM refs r
LEFT JOIN (SELECT r.id, r.qualifier, COALESCE(MIN(a.table_name),
                  CASE WHEN list_contains(""" + KNOWN + """, lower(r.qualifier)) THEN lower(r.qualifier) END) AS resolved_table
           FROM refs r LEFT JOIN al a ON r.id = a.id AND lower(r.qualifier) = a.alias
           GROUP BY r.id, r.qualifier) res ON r.id = res.id AND r.qualifier = res.qualifier
LEFT JOIN catalog c ON c.table_name = res.resolved_table AND c.column_name = lower(r.column_name)
LEFT JOIN (SELECT column_name, MIN(table_name) AS suggested_table FROM catalog GROUP BY column_name) sg
  ON sg.column_name = lower(r.column_name)""",
    catalog_sql(),
    f"""refs AS (SELECT DISTINCT id, unnest(regexp_extract_all(sql, {q(T.QUALIFIED_RE)}, 1)) AS qualifier,
                    unnest(regexp_extract_all(sql, {q(T.QUALIFIED_RE)}, 2)) AS column_name FROM ex)""",
    f"""al AS (SELECT DISTINCT id, lower(t) AS table_name, lower(a) AS alias FROM (
              SELECT id, unnest(regexp_extract_all(sql, {q(ALIAS_RE)}, 1)) AS t,
                     unnest(regexp_extract_all(sql, {q(ALIAS_RE)}, 2)) AS a FROM ex) x
            WHERE a <> '' AND NOT list_contains({_NOT_ALIAS}, upper(a)))"""))
def ref_report(spark, sf):
    """D-25: every ``qualifier.column`` reference with the table its alias
    resolves to, whether the column exists there, and a table that has the
    column.  A report only -- the SQL text is never rewritten."""
    return C.ref_report(C.with_sql(_log(spark, sf)), ALIAS_RE)
