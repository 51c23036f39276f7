"""Voting among candidate answers: exact-text majority with a named
fallback (A28/A29/D-23) and leader clustering by clause overlap (D-20..D-22).

Candidates (question_id, seq, source, raw_text) are derived from the
driver's tables: each order is a question and each of its lineitems one
candidate, whose text is the query-log answer of the lineitem's part; the
source is the plugin that produced it (by line number).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions import sqltext as T
from fiscus.operators.corpus import query_log, query_log_exprs
from fiscus.plans.registry import register
from fiscus.plans.star import CATALOG_TABLES
from fiscus.session import spread, written
from fiscus.sources.tables import Tables

col = F.col

# Candidate sources and the fallback source.
SOURCES = ["structure_specialist", "value_specialist", "aggregation_specialist", "join_specialist"]
FALLBACK_SOURCE = "structure_specialist"
OVERLAP_MIN = 0.6
FUZZY_MIN = 0.8


def log_texts(t: Tables) -> DataFrame:
    """(l_partkey, sql): the extracted SQL of each log answer."""
    return spread(query_log(t)).select(col("id").alias("l_partkey"), T.extract_sql(col("text")).alias("sql"))


def candidates(t: Tables, derive=None) -> DataFrame:
    """Candidates with their extracted SQL (and what ``derive`` adds to the
    log): text rules run once per log answer, before the join repeats it."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    log = derive(log_texts(t)) if derive else log_texts(t)
    src = F.array(*[F.lit(s) for s in SOURCES])
    # the log has a row per part, however little its file measures
    return (li.join(log.hint("merge"), "l_partkey")
            .select(col("l_orderkey").alias("question_id"),
                    col("l_linenumber").alias("seq"),
                    F.element_at(src, (F.pmod(col("l_linenumber") - 1, F.lit(len(SOURCES))) + 1).cast("int"))
                    .alias("source"),
                    "l_suppkey", *log.columns))


ARRIVAL = ["seq", "l_partkey", "l_suppkey"]


# ---------------------------------------------------------------- A28 / A29 / D-23
def with_text_keys(log: DataFrame) -> DataFrame:
    """``text_key`` and ``ci_key``: 64-bit hashes of the SQL and of its lower case."""
    return log.withColumn("text_key", F.xxhash64("sql")).withColumn("ci_key", F.xxhash64(F.lower("sql")))


def majority_vote(cands: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Most frequent extracted SQL per question if it has more than one
    vote (ties: earliest arrival), else the fallback source's first answer,
    else the first answer; ``votes`` counts candidates equal to the answer
    ignoring case.

    Three nested aggregates, each a partial (map-side) aggregate keyed by a
    prefix of the previous key -- (question, text) -> (question, lower(text))
    -> question -- with no join and no second pass over the candidates: the
    case-insensitive level carries its exact-text champion, first arrival
    and first fallback answer, so the final level can pick the answer and
    read its vote count from the same row.

    With ``texts`` (l_partkey, text_key, sql) candidates carry ``text_key`` and
    ``ci_key`` in place of ``sql``: texts of a question are told apart by the keys, and
    only the answer's text is looked up."""
    fb = col("source") == FALLBACK_SOURCE
    text, ci = (col("sql"), F.lower("sql")) if texts is None else (col("text_key"), col("ci_key"))
    per_text = (cands.withColumn("_arr", F.struct(*ARRIVAL))
                .groupBy("question_id", text.alias("_text"), ci.alias("_ci"))
                .agg(F.count(F.lit(1)).alias("votes"), F.min("_arr").alias("_first"),
                     F.min(F.when(fb, col("_arr"))).alias("_fb_first")))
    # the least struct begins with what decides and ends with the answer: nothing is carried twice
    fb_first = F.when(col("_fb_first").isNotNull(), F.struct(col("_fb_first").alias("f"), "_text"))
    per_ci = (per_text.groupBy("question_id", "_ci")
              .agg(F.sum("votes").alias("ci_votes"), F.count(F.lit(1)).alias("n_exact"),
                   F.min(F.struct((-col("votes")).alias("v"), col("_first").alias("f"), "_text")).alias("_champ"),
                   F.min(F.struct(col("_first").alias("f"), "_text")).alias("_gfirst"), F.min(fb_first).alias("_gfb")))

    def answer(best: str, *order: str) -> Column:
        return F.when(col(best).isNotNull(), F.struct(*[col(f"{best}.{c}").alias(c) for c in order],
                                                      col(f"{best}._text").alias("text"), col("ci_votes").alias("ci")))

    q = per_ci.groupBy("question_id").agg(
        F.min(answer("_champ", "v", "f")).alias("_top"), F.min(answer("_gfirst", "f")).alias("_first"),
        F.min(answer("_gfb", "f")).alias("_fb"),
        F.sum("ci_votes").alias("n_candidates"),
        F.sum("n_exact").alias("unique_candidates"))
    consensus = col("_top.v") < -1
    has_fb = col("_fb").isNotNull()

    def pick(field: str) -> Column:
        return F.when(consensus, col(f"_top.{field}")).when(has_fb, col(f"_fb.{field}")).otherwise(col(f"_first.{field}"))

    best = q.select(
        "question_id", pick("text").alias("text"), pick("f.l_partkey").alias("part"),
        F.when(consensus, "consensus").when(has_fb, FALLBACK_SOURCE).otherwise("first_candidate")
         .alias("selection_method"),
        col("n_candidates").cast("bigint").alias("n_candidates"),
        col("unique_candidates").cast("bigint").alias("unique_candidates"), pick("ci").cast("bigint").alias("votes"))
    if texts is None:
        best = best.withColumnRenamed("text", "sql")
    else:
        said = texts.select(col("l_partkey").alias("part"), col("text_key").alias("text"), "sql").dropDuplicates(["part", "text"])
        best = best.join(said.hint("merge"), ["part", "text"])
    return best.select("question_id", col("sql").alias("best_sql"), "selection_method", "n_candidates", "unique_candidates", "votes")


_QL_SQL = "ql AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in query_log_exprs("VARCHAR").items()) + " FROM part)"


def _vote_oracle() -> str:
    from fiscus.operators.corpus_queries import d_extract_sql
    src = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
    return f"""
WITH {_QL_SQL},
c AS (SELECT l.l_orderkey AS question_id, l.l_linenumber AS seq, l.l_partkey, l.l_suppkey,
             {src}[((l.l_linenumber - 1) % {len(SOURCES)}) + 1] AS source,
             {d_extract_sql('ql.text')} AS sql
      FROM lineitem l JOIN ql ON l.l_partkey = ql.id),
pt AS (SELECT question_id, sql, COUNT(*) AS votes, MIN((seq, l_partkey, l_suppkey)) AS first FROM c
       GROUP BY question_id, sql),
top AS (SELECT question_id, sql AS top_sql, votes AS top_votes FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first) AS rn FROM pt) x
        WHERE rn = 1),
st AS (SELECT question_id, COUNT(*) AS n_candidates, COUNT(DISTINCT sql) AS unique_candidates,
              arg_min(sql, (seq, l_partkey, l_suppkey)) FILTER (WHERE source = '{FALLBACK_SOURCE}') AS fb,
              arg_min(sql, (seq, l_partkey, l_suppkey)) AS first_sql
       FROM c GROUP BY question_id),
o AS (SELECT top.question_id,
             CASE WHEN top_votes > 1 THEN top_sql ELSE COALESCE(fb, first_sql) END AS best_sql,
             CASE WHEN top_votes > 1 THEN 'consensus' WHEN fb IS NOT NULL THEN '{FALLBACK_SOURCE}'
                  ELSE 'first_candidate' END AS selection_method,
             CAST(n_candidates AS BIGINT) AS n_candidates, CAST(unique_candidates AS BIGINT) AS unique_candidates
      FROM top JOIN st ON top.question_id = st.question_id)
SELECT o.*, CAST((SELECT COUNT(*) FROM c WHERE c.question_id = o.question_id
                  AND lower(c.sql) = lower(o.best_sql)) AS BIGINT) AS votes
FROM o"""


@register("majority_vote", _vote_oracle())
def majority_vote_q(spark, sf):
    t = Tables(spark, sf)
    cands = candidates(t, lambda log: with_text_keys(log).drop("sql"))
    return majority_vote(cands, with_text_keys(log_texts(t)))


# ---------------------------------------------------------------- D-20 .. D-22
def _ratio_ok(ref, names):
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda t: (
        F.lit(1.0) - F.levenshtein(ref, t) / F.greatest(F.length(ref), F.length(t))) >= FUZZY_MIN)


def with_clauses(log: DataFrame) -> DataFrame:
    """D-4 + D-19 + D-20: normalized statement, one item set per compared
    clause, and validity (some clause present; every FROM/JOIN table is a
    CTE or a catalog table, exactly or with edit ratio >= 0.8)."""
    fixed = log.withColumn("fixed", T.normalize_sql(col("sql")))
    sets = F.array(*[T.clause_items(T.clause(col("fixed"), c), c) for c in T.COMPARED_CLAUSES])
    tables = F.array_except(T.table_refs(col("fixed")), T.cte_names(col("fixed")))
    return (fixed.withColumn("clauses", sets)
            .withColumn("valid", F.exists("clauses", lambda s: F.size(s) > 0)
                        & F.forall(tables, lambda r: _ratio_ok(r, CATALOG_TABLES))))


def clause_overlap(a: Column, b: Column) -> Column:
    """D-21: share of the larger item set that both hold; 1 unless both hold items."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / larger)


def with_signature(log: DataFrame) -> DataFrame:
    """``sig``: the clause item sets as sorted 64-bit hashes.  Statements of one
    signature agree with the same others, so clustering works on signatures."""
    return log.withColumn("sig", F.transform("clauses", lambda s: F.array_sort(F.transform(s, lambda x: F.xxhash64(x)))))


def _first_agreeing(leaders: Column, sig: Column) -> Column:
    """1-based place of the first leader that agrees on every clause; 0 without one."""
    return F.array_position(F.transform(leaders, lambda c: F.forall(
        F.zip_with(c["sig"], sig, clause_overlap), lambda s: s >= OVERLAP_MIN)), True)


def _join_leader(leaders: Column, cand: Column) -> Column:
    """D-22 step: the first leader that agrees gains the candidate's weight;
    without one the candidate leads a new cluster."""
    new = F.struct(cand["sig"].alias("sig"), cand["first"]["fixed"].alias("fixed"), cand["weight"].alias("size"))
    grown = F.transform(F.array(_first_agreeing(leaders, cand["sig"])), lambda at: F.when(
        at == 0, F.concat(leaders, F.array(new))).otherwise(F.transform(leaders, lambda c, i: F.struct(
            c["sig"].alias("sig"), c["fixed"].alias("fixed"),
            (c["size"] + F.when(i + 1 == at, cand["weight"]).otherwise(0)).alias("size")))))
    return F.element_at(grown, 1)


LEADERS = "array<struct<sig:array<array<bigint>>,fixed:string,size:bigint>>"
#: distinct signatures of a question decided by one fold: in the first round, and at most
FIRST_BLOCK, LARGEST_BLOCK = 64, 512


def _round(todo: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """One round over undecided signatures: (leaders per question, the later
    signatures with the place of their leader, 0 while undecided).  Only questions
    of more than ``block`` signatures have later ones, None if there is none."""
    w = Window.partitionBy("question_id").orderBy("first")
    early = todo.withColumn("at", F.row_number().over(w)).where(col("at") <= block + 1)
    inside = F.when(col("at") <= block, F.struct("first", "sig", "weight"))
    early = early.groupBy("question_id").agg(F.array_sort(F.collect_list(inside)).alias("b"), (F.max("at") > block).alias("more"))
    led = written(early.select("question_id", F.element_at("b", -1)["first"].alias("last"),
                               F.aggregate("b", F.array().cast(LEADERS), _join_leader).alias("leaders"), "more"), "leaders")
    if led.where("more").isEmpty():
        return led, None
    later = todo.join(led.where("more").select(col("question_id").alias("q"), "last", "leaders"),
                      col("question_id").eqNullSafe(col("q")) & (col("first") > col("last")))
    return led, written(later.select(*todo.columns, _first_agreeing(col("leaders"), col("sig")).alias("at")), "later")


def leader_rounds(nodes: DataFrame, block: int = FIRST_BLOCK) -> DataFrame:
    """(question_id, round, no, fixed, size) per cluster of ``nodes``
    (question_id, first, sig, weight), equal to the fold over each question.

    A round folds the ``block`` earliest undecided signatures of every
    question; all later ones are held, as rows of their own, against the
    leaders it made and join the first that agrees.  What agrees with none goes
    on to the next round, whose block is twice as large, so no task holds more of
    a question than a block and its leaders.  Rounds are written to the
    shared folder: a lost executor repeats a part of one round."""
    todo, parts, n = nodes, [], 0
    while True:
        led, later = _round(todo, block)
        parts.append(led.select("question_id", F.lit(n).alias("round"), F.posexplode("leaders").alias("no", "c"))
                     .select("question_id", "round", (col("no") + 1).cast("bigint").alias("no"), "c.fixed", "c.size"))
        if later is None:
            break
        todo = later.where(col("at") == 0).drop("at")
        parts.append(later.where(col("at") > 0).groupBy("question_id", "at").agg(F.sum("weight").alias("size"))
                     .select("question_id", F.lit(n).alias("round"), col("at").alias("no"),
                             F.lit(None).cast("string").alias("fixed"), "size"))
        if todo.isEmpty():
            break
        n, block = n + 1, min(2 * block, LARGEST_BLOCK)
    if len(parts) == 1:
        return parts[0]
    return (reduce(DataFrame.unionByName, parts).groupBy("question_id", "round", "no")
            .agg(F.max("fixed").alias("fixed"), F.sum("size").alias("size")))


def candidate_clusters(cands: DataFrame, block: int = FIRST_BLOCK) -> DataFrame:
    """Leader clustering per question, in arrival order, of candidates that
    carry ``with_clauses`` columns.  Candidates are first combined to distinct
    signatures, which are clustered in rounds (``leader_rounds``).  The largest
    cluster (the first made on ties) gives its leader; without a valid
    candidate the first arrival is taken.  Item sets, and signatures, are compared
    by 64-bit hashes.  An empty table gives no rows; a null question is a question."""
    cands = cands if "sig" in cands.columns else with_signature(cands)
    # grouped, and sorted, by one hash: that of nested arrays does not tell where one ends
    key = F.xxhash64("sig", F.transform("sig", F.size)).alias("key")
    texts = cands.groupBy("question_id", "valid", key).agg(
        F.min(F.struct(*ARRIVAL, "fixed", "sig")).alias("f"), F.count(F.lit(1)).alias("weight"))
    texts = written(texts.select("question_id", "valid", F.struct(*[col(f"f.{c}").alias(c) for c in (*ARRIVAL, "fixed")]).alias("first"),
                                 col("f.sig").alias("sig"), "weight"), "signatures")
    per_q = texts.groupBy("question_id").agg(
        F.min("first")["fixed"].alias("first_sql"),
        F.coalesce(F.sum(F.when(col("valid"), col("weight"))), F.lit(0)).cast("bigint").alias("n_valid"))
    clusters = leader_rounds(texts.where("valid").select("question_id", "first", "sig", "weight"), block)
    best = clusters.groupBy(col("question_id").alias("q")).agg(
        F.max(F.struct("size", (-col("round")).alias("r"), (-col("no")).alias("n"), "fixed")).alias("best"),
        F.count(F.lit(1)).alias("n_clusters"))
    some = col("best").isNotNull()
    return per_q.join(best, col("question_id").eqNullSafe(col("q")), "left").select(
        "question_id", F.when(some, col("best.fixed")).otherwise(col("first_sql")).alias("best_sql"),
        F.coalesce("best.size", F.lit(0)).cast("bigint").alias("cluster_size"), "n_valid",
        F.coalesce("n_clusters", F.lit(0)).cast("bigint").alias("n_clusters"),
        F.when(some, "largest_cluster").otherwise("first_candidate").alias("selection_method"))


def _cluster_oracle() -> str:
    """The fold, one candidate of every question a step, over all lines."""
    from fiscus.operators import corpus_queries as Q
    items = []
    for name in T.COMPARED_CLAUSES:
        parts = ("string_split_regex(b, '(?i)\\s+and\\s+')" if name in ("where", "having") else "string_split(b, ',')")
        body = f"coalesce({Q._d_clause('fixed', name)}, '')"
        items.append(f"list_distinct(list_filter(list_transform({parts.replace('(b,', f'({body},')}, "
                     "lambda x: lower(trim(x))), lambda x: x <> ''))")
    near = f"""len(list_filter({Q.KNOWN}, lambda t:
        1.0 - levenshtein(r, t) / CAST(greatest(length(r), length(t)) AS DOUBLE) >= {FUZZY_MIN})) = 0"""
    agree = " AND ".join(f"""(len(l.cl[{i}]) = 0 OR len(v.cl[{i}]) = 0
        OR len(list_intersect(l.cl[{i}], v.cl[{i}])) >= {OVERLAP_MIN} * greatest(len(l.cl[{i}]), len(v.cl[{i}])))"""
                         for i in range(1, len(items) + 1))
    return f"""
WITH RECURSIVE {_QL_SQL},
n AS (SELECT id, {Q.d_strip(Q._NORM)} AS fixed FROM (SELECT id, {Q.d_extract_sql('text')} AS sql FROM ql) x),
lg AS MATERIALIZED (
  SELECT *, len(list_filter(cl, lambda s: len(s) > 0)) > 0
         AND len(list_filter(refs, lambda r: NOT list_contains(ctes, r) AND {near})) = 0 AS valid
  FROM (SELECT id, fixed, [{", ".join(items)}] AS cl, {Q.d_table_refs('fixed')} AS refs,
               {Q.d_cte_names('fixed')} AS ctes FROM n) y),
c AS MATERIALIZED (
  SELECT l.l_orderkey AS question_id, lg.fixed, lg.cl, lg.valid,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS arrival
  FROM lineitem l JOIN lg ON l.l_partkey = lg.id),
v AS MATERIALIZED (
  SELECT question_id, fixed, cl, row_number() OVER (PARTITION BY question_id ORDER BY arrival) AS nth FROM c WHERE valid),
f AS (
  SELECT question_id, CAST(1 AS BIGINT) AS nth, [{{'cl': cl, 'fixed': fixed}}] AS leaders, [CAST(1 AS BIGINT)] AS joined
  FROM v WHERE nth = 1
  UNION ALL
  SELECT question_id, nth, CASE WHEN p IS NULL THEN list_append(leaders, {{'cl': cl, 'fixed': fixed}}) ELSE leaders END,
         list_append(joined, coalesce(p, len(leaders) + 1))
  FROM (SELECT v.*, f.leaders, f.joined,
               nullif(list_position(list_transform(f.leaders, lambda l: {agree}), true), 0) AS p
        FROM f JOIN v ON v.question_id = f.question_id AND v.nth = f.nth + 1) s),
done AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY nth DESC) = 1),
size AS (SELECT question_id, no, COUNT(*) AS members FROM (SELECT question_id, unnest(joined) AS no FROM done) u GROUP BY question_id, no),
top AS (SELECT * FROM size QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY members DESC, no) = 1)
SELECT a.question_id, CASE WHEN d.nth IS NULL THEN a.first_sql ELSE d.leaders[t.no].fixed END AS best_sql,
       CAST(coalesce(t.members, 0) AS BIGINT) AS cluster_size, CAST(a.n_valid AS BIGINT) AS n_valid,
       CAST(coalesce(len(d.leaders), 0) AS BIGINT) AS n_clusters,
       CASE WHEN d.nth IS NULL THEN 'first_candidate' ELSE 'largest_cluster' END AS selection_method
FROM (SELECT question_id, arg_min(fixed, arrival) AS first_sql, COUNT(*) FILTER (WHERE valid) AS n_valid FROM c GROUP BY question_id) a
LEFT JOIN done d ON d.question_id = a.question_id LEFT JOIN top t ON t.question_id = a.question_id"""


@register("candidate_clusters", _cluster_oracle())
def candidate_clusters_q(spark, sf):
    return candidate_clusters(candidates(Tables(spark, sf), lambda log: with_signature(with_clauses(log))))
