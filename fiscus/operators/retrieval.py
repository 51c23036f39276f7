"""Retrieval: dense top-k, two-stage table -> column linking, token-overlap
scorer, TF-IDF terms, shingle containment, fuzzy name matching, and the
schema / prompt text built from retrieved items.

Question x item scoring (reference: every question against every schema
item) packs the items in blocks of bounded size.  The number of blocks follows
from the item count inside the plan; a question meets each block once, scores
it inside codegen and keeps its top k, and the block winners are ranked.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions import sqltext as T
from fiscus.functions.vectors import cosine, norm, sigmoid
from fiscus.plans.analytics import attach_scalar
from fiscus.plans.registry import register
from fiscus.operators.corpus import query_log_exprs
from fiscus.plans.star import STAR_CATALOG
from fiscus.session import spread, written
from fiscus.sources.tables import Tables

col = F.col

ITEMS_PER_BLOCK = 1_024


# ---------------------------------------------------------------- centroids
def centroids(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    """Mean vector per key (JVM Summarizer: partial aggregation, no explode)."""
    return (df.groupBy(*keys)
            .agg(Summarizer.mean(array_to_vector(col(vec))).alias("_m"), F.count(F.lit(1)).alias("n"))
            .select(*keys, vector_to_array("_m").alias("vec"), "n"))


# ---------------------------------------------------------------- top-k core
def topk_items(queries: DataFrame, qid: str, qval: str, items: DataFrame, iid: str, ival: str,
               k: int, score_fn, block_items: int = ITEMS_PER_BLOCK,
               min_score: float | None = None) -> DataFrame:
    """Top ``k`` items per query under ``score_fn(query_value, item_value)``.

    Returns (qid, rank, iid, score); ties broken by item id.  Blocks hold
    about ``block_items`` items.  With fewer blocks than shuffle partitions
    each block is copied under several salts and the queries are dealt over
    them, so that no join key holds all queries; AQE broadcasts the blocks
    when it measures them small."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = (items.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_items), F.lit(1)).alias("_blocks"))
             .select("_blocks", F.ceil(F.lit(tasks) / col("_blocks")).alias("_salts")))
    blocks = (attach_scalar(items.select(F.struct(col(iid).alias("id"), col(ival).alias("v")).alias("_it")), shape)
              .groupBy(F.pmod(F.xxhash64("_it.id"), col("_blocks")).alias("_b"), "_salts")
              .agg(F.collect_list("_it").alias("_items"))
              .select("_b", "_items", F.explode(F.sequence(F.lit(0).cast("bigint"), col("_salts") - 1)).alias("_s")))
    asked = (attach_scalar(queries.select(col(qid), col(qval).alias("_q")), shape)
             .select(qid, "_q", F.pmod(F.xxhash64(qid), col("_salts")).alias("_s"),
                     F.explode(F.sequence(F.lit(0).cast("bigint"), col("_blocks") - 1)).alias("_b")))
    scored = F.transform("_items", lambda it: F.struct((-score_fn(col("_q"), it["v"])).alias("neg"), it["id"].alias("id")))
    kept = F.filter(scored, lambda s: s["neg"].isNotNull() if min_score is None else s["neg"] <= -min_score)
    best = (asked.join(blocks, ["_b", "_s"])
            .select(qid, F.explode(F.slice(F.array_sort(kept), 1, k)).alias("_w")))
    w = Window.partitionBy(qid).orderBy("_w")
    return (best.withColumn("rank", F.row_number().over(w)).where(col("rank") <= k)
            .select(qid, "rank", col("_w.id").alias(iid), (-col("_w.neg")).alias("score")))


def with_norm(df: DataFrame, vec: str) -> DataFrame:
    """Replace a vector by (v, n): the norm is computed once per row, not per pair."""
    return df.withColumn(vec, F.struct(col(vec).alias("v"), norm(col(vec)).alias("n")))


def dense_topk(queries: DataFrame, qid: str, qvec: str, items: DataFrame, iid: str, ivec: str, k: int,
               block_items: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Top ``k`` items per query by cosine."""
    return topk_items(with_norm(queries.select(qid, qvec), qvec), qid, qvec,
                      with_norm(items.select(iid, ivec), ivec), iid, ivec, k,
                      lambda a, b: cosine(a["v"], b["v"], a["n"], b["n"]), block_items)


# ---------------------------------------------------------------- D-29 / O11
def label_items(emb: DataFrame) -> DataFrame:
    return centroids(emb, ["label"]).select("label", "vec", "n")


TOPK_CTES = """
d AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS cvec, MAX(n) AS n
      FROM (SELECT label, pos, AVG(CAST(x AS DOUBLE)) AS m, COUNT(*) AS n FROM d GROUP BY label, pos) a
      GROUP BY label),
s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.cvec) AS score
      FROM embeddings e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s)"""


@register("topk_cosine", f"""WITH {TOPK_CTES.strip()}
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, ROUND(score, 6) AS score FROM r WHERE rank <= 3""")
def topk_cosine(spark, sf):
    """Every embedding is a question; items are the label ('table')
    centroids; top 3 by cosine."""
    emb = Tables(spark, sf).embeddings
    top = dense_topk(emb, "vec_id", "embedding", label_items(emb), "label", "vec", 3)
    return top.select("vec_id", col("rank").cast("int"), "label", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- W8
@register("topk_per_group", f"""WITH {TOPK_CTES.strip()},
own AS (SELECT e.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.cvec) AS score
        FROM embeddings e JOIN c ON e.label = c.label)
SELECT label, vec_id, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM own) x
WHERE rank <= 3""")
def topk_per_group(spark, sf):
    """Top 3 members per label by similarity to their own centroid.  The
    ``row_number() <= k`` filter is planned as a WindowGroupLimit, so each
    task keeps only k rows per label before the shuffle (a label holding a
    third of the rows does not reach the window whole)."""
    emb = Tables(spark, sf).embeddings
    cents = label_items(emb).select("label", col("vec").alias("cvec"))
    scored = emb.join(cents, "label").select("label", "vec_id", cosine(col("embedding"), col("cvec")).alias("score"))
    w = Window.partitionBy("label").orderBy(col("score").desc(), col("vec_id"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(col("rank") <= 3)
            .select("label", "vec_id", F.round("score", 6).alias("score"), "rank"))


# ---------------------------------------------------------------- D-30
def quadrant(vec: Column) -> Column:
    """'Column' of a vector inside its label: signs of the first two dims."""
    return (F.when(F.element_at(vec, 1) > 0, 2).otherwise(0)
            + F.when(F.element_at(vec, 2) > 0, 1).otherwise(0)).cast("int")


def column_items(emb: DataFrame) -> DataFrame:
    return centroids(emb.withColumn("column_no", quadrant(col("embedding"))), ["label", "column_no"])


def two_stage(emb: DataFrame, k_tables: int = 2, k_columns: int = 3) -> DataFrame:
    """D-30: top tables per question, then top columns inside each of them,
    re-ranked globally by score."""
    tables = dense_topk(emb, "vec_id", "embedding", label_items(emb), "label", "vec", k_tables)
    # stage 2: an equi-join of (question, picked table) with that table's
    # columns -- fan-out bounded by k_tables x columns per table
    cols = column_items(emb).select("label", "column_no", col("vec").alias("cvec"))
    sc = (tables.select("vec_id", "label").join(emb.select("vec_id", "embedding"), "vec_id")
          .join(cols, "label")
          .select("vec_id", "label", "column_no", cosine(col("embedding"), col("cvec")).alias("score"))
          .where(col("score").isNotNull()))
    w_t = Window.partitionBy("vec_id", "label").orderBy(col("score").desc(), col("column_no"))
    w_g = Window.partitionBy("vec_id").orderBy(col("score").desc(), col("label"), col("column_no"))
    return (sc.withColumn("_r", F.row_number().over(w_t)).where(col("_r") <= k_columns)
            .withColumn("rank", F.row_number().over(w_g)).drop("_r"))


TWO_STAGE_CTES = TOPK_CTES.strip() + """,
cc AS (SELECT label, column_no, list(m ORDER BY pos) AS cvec FROM (
         SELECT label, column_no, pos, AVG(CAST(x AS DOUBLE)) AS m FROM (
           SELECT label, (CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END)
                    AS column_no, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x
           FROM embeddings) u GROUP BY label, column_no, pos) a GROUP BY label, column_no),
t2 AS (SELECT vec_id, label FROM r WHERE rank <= 2),
sc AS (SELECT e.vec_id, cc.label, cc.column_no,
              list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), cc.cvec) AS score
       FROM embeddings e JOIN t2 ON e.vec_id = t2.vec_id JOIN cc ON cc.label = t2.label),
pt AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY score DESC, column_no) AS rt FROM sc),
g AS (SELECT vec_id, label, column_no, score,
             row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label, column_no) AS rank
      FROM pt WHERE rt <= 3)"""


@register("topk_two_stage", f"""WITH {TWO_STAGE_CTES}
SELECT vec_id, label, CAST(column_no AS INTEGER) AS column_no, ROUND(score, 6) AS score,
       CAST(rank AS INTEGER) AS rank FROM g""")
def topk_two_stage(spark, sf):
    out = two_stage(Tables(spark, sf).embeddings)
    return out.select("vec_id", "label", "column_no", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- D-32 / A34
@register("schema_text", f"""WITH {TWO_STAGE_CTES},
per_t AS (SELECT vec_id, label, MIN(rank) AS first_rank,
                 'label_' || CAST(label AS VARCHAR) || '(' ||
                 string_agg('c' || CAST(column_no AS VARCHAR), ', ' ORDER BY rank) || ')' AS t
          FROM g GROUP BY vec_id, label)
SELECT vec_id, string_agg(t, '; ' ORDER BY first_rank) AS schema_text FROM per_t GROUP BY vec_id""")
def schema_text(spark, sf):
    """Linked schema rendered per question: tables in order of their best
    column, columns in rank order.  Every group holds at most
    k_tables x k_columns rows, so the ordered string aggregation is bounded."""
    g = two_stage(Tables(spark, sf).embeddings)
    per_t = (g.groupBy("vec_id", "label")
             .agg(F.min("rank").alias("first_rank"),
                  F.array_sort(F.collect_list(F.struct("rank", "column_no"))).alias("_c"))
             .select("vec_id", "first_rank",
                     F.concat(F.lit("label_"), col("label").cast("string"), F.lit("("),
                              F.array_join(F.transform("_c", lambda x: F.concat(
                                  F.lit("c"), x["column_no"].cast("string"))), ", "),
                              F.lit(")")).alias("t")))
    return (per_t.groupBy("vec_id")
            .agg(F.array_sort(F.collect_list(F.struct("first_rank", "t"))).alias("_t"))
            .select("vec_id", F.array_join(F.transform("_t", lambda x: x["t"]), "; ").alias("schema_text")))


# ---------------------------------------------------------------- D-33
@register("rank_detail_summary", f"""WITH {TWO_STAGE_CTES},
cols AS (SELECT label, string_agg('c' || CAST(column_no AS VARCHAR), ', ' ORDER BY column_no) AS cl FROM cc GROUP BY label),
lines AS (SELECT r.vec_id, r.rank,
                 CASE WHEN r.rank <= 3 THEN 'label_' || CAST(r.label AS VARCHAR) || ': ' || cols.cl
                      ELSE 'label_' || CAST(r.label AS VARCHAR) || ' (' || CAST(c.n AS VARCHAR) || ' vectors)' END AS line
          FROM r JOIN cols ON r.label = cols.label JOIN c ON r.label = c.label WHERE r.rank <= 5)
SELECT vec_id, string_agg(line, chr(10) ORDER BY rank) AS schema_prompt FROM lines GROUP BY vec_id""")
def rank_detail_summary(spark, sf):
    """D-33: top 3 tables in detail (all their columns), ranks 4-5 as a
    one-line summary."""
    emb = Tables(spark, sf).embeddings
    labels = label_items(emb)
    top5 = dense_topk(emb, "vec_id", "embedding", labels, "label", "vec", 5)
    cl = (column_items(emb).groupBy("label")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list("column_no")),
                                        lambda c: F.concat(F.lit("c"), c.cast("string"))), ", ").alias("cl")))
    info = cl.join(labels.select("label", "n"), "label")  # one row per label: bounded
    lines = top5.join(info, "label").select(
        "vec_id", "rank",
        F.when(col("rank") <= 3, F.concat(F.lit("label_"), col("label").cast("string"), F.lit(": "), col("cl")))
         .otherwise(F.concat(F.lit("label_"), col("label").cast("string"), F.lit(" ("),
                             col("n").cast("string"), F.lit(" vectors)"))).alias("line"))
    return (lines.groupBy("vec_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))
            .select("vec_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("schema_prompt")))


# ---------------------------------------------------------------- D-31 / N5
def catalog_items(spark) -> DataFrame:
    rows = [(i, f"{t}.{c}") for i, (t, c, _, _) in enumerate(STAR_CATALOG)]
    return (spark.createDataFrame(rows, "item_id int, item string")
            .withColumn("tokens", F.array_distinct(F.split(F.regexp_replace("item", r"\.", "_"), "_"))))


def token_overlap(q_tokens: Column, i_tokens: Column) -> Column:
    """Share of the item's tokens present in the question (0 when none)."""
    return F.size(F.array_intersect(q_tokens, i_tokens)) / F.size(i_tokens)


QUESTION_SQL = query_log_exprs("VARCHAR")["question"]
_CAT_ITEMS_SQL = "items(item_id, item) AS (VALUES " + ", ".join(
    f"({i}, '{t}.{c}')" for i, (t, c, _, _) in enumerate(STAR_CATALOG)) + ")"


@register("topk_token_overlap", f"""
WITH {_CAT_ITEMS_SQL},
it AS (SELECT item_id, item, list_distinct(string_split(replace(item, '.', '_'), '_')) AS tokens FROM items),
qs AS (SELECT p_partkey AS id, list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+')) AS qt FROM (
         SELECT p_partkey, {QUESTION_SQL} AS q FROM part) p),
s AS (SELECT qs.id, it.item, len(list_intersect(qs.qt, it.tokens)) / len(it.tokens) AS score, it.item_id
      FROM qs, it),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0)
SELECT id, CAST(rank AS INTEGER) AS rank, item, ROUND(score, 6) AS score,
       ROUND(1.0 / (1.0 + exp(-(4 * score - 2))), 6) AS probability
FROM r WHERE rank <= 3""")
def topk_token_overlap(spark, sf):
    """D-31: same retrieval contract as D-29 with a lexical scorer: question
    tokens vs catalog item tokens; probability = two-logit softmax."""
    from fiscus.operators.corpus import query_log
    log = query_log(Tables(spark, sf)).select(
        "id", F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9_]+"), 0)).alias("qt"))
    items = catalog_items(spark)
    top = topk_items(log, "id", "qt", items, "item_id", "tokens", 3, token_overlap, min_score=1e-12)
    return (top.join(items.select("item_id", "item"), "item_id")
            .select("id", col("rank").cast("int"), "item", F.round("score", 6).alias("score"),
                    F.round(sigmoid(4 * col("score") - 2), 6).alias("probability")))


# ---------------------------------------------------------------- D-38
#: words with a number each that every task may hold whole
WORDS_SENT = 100_000
WORD_LETTERS = r"[\p{L}\p{M}]+"


def tokens_lower(text: Column) -> Column:
    """Words of letters of any script, lower-cased after extraction."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_LETTERS), 0), F.lower)


def tfidf_top_terms(docs: DataFrame, id_col: str, text_col: str, k: int = 5) -> DataFrame:
    """D-38: exact TF-IDF per (doc, term) as DataFrame aggregates; top k terms
    per document.  tf = count / doc tokens, idf = ln(N / df)."""
    # the document length travels with its tokens (no separate aggregate + join)
    toks = (docs.select(id_col, tokens_lower(col(text_col)).alias("_t"))
            .select(id_col, F.size("_t").alias("dlen"), F.explode_outer("_t").alias("term")).where("term IS NOT NULL"))
    tf = written(toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("cnt"), F.first("dlen").alias("dlen")), "tf")
    df_ = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    df_ = F.broadcast(df_) if df_.limit(WORDS_SENT + 1).count() <= WORDS_SENT else df_.hint("merge")
    n_docs = docs.select(id_col).distinct().agg(F.count(F.lit(1)).alias("N"))
    scored = (attach_scalar(tf.join(df_, "term"), n_docs)
              .withColumn("tfidf", col("cnt") / col("dlen") * F.log(col("N") / col("df"))))
    w = Window.partitionBy(id_col).orderBy(col("tfidf").desc(), col("term"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(col("rank") <= k)
            .select(id_col, "rank", "term", F.round("tfidf", 6).alias("tfidf")))


@register("tfidf_topk", f"""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{WORD_LETTERS}'), lambda x: lower(x))) AS term
           FROM documents),
tf AS (SELECT doc_id, term, COUNT(*) AS cnt FROM t GROUP BY doc_id, term),
dl AS (SELECT doc_id, SUM(cnt) AS dlen FROM tf GROUP BY doc_id),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
n AS (SELECT COUNT(DISTINCT doc_id) AS n FROM documents),
s AS (SELECT tf.doc_id, tf.term, tf.cnt / dl.dlen * ln(n.n / df.df) AS tfidf
      FROM tf JOIN dl ON tf.doc_id = dl.doc_id JOIN df ON tf.term = df.term, n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank FROM s)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, ROUND(tfidf, 6) AS tfidf FROM r WHERE rank <= 5""")
def tfidf_topk(spark, sf):
    return tfidf_top_terms(Tables(spark, sf).documents, "doc_id", "text", 5)


# ---------------------------------------------------------------- D-37
def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct word n-grams of a token array, built from n shifted slices of
    the array zipped together (O(length), no per-position slice).  Pass a
    materialized column: the array is referenced n times."""
    m = F.size(tokens) - (n - 1)
    grams = F.slice(tokens, 1, m)
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(tokens, k, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def containment_matches(docs: DataFrame, passages: DataFrame, threshold: float = 0.5,
                        n: int = 3) -> DataFrame:
    """D-37 (exact): passages whose word 3-shingles are at least
    ``threshold`` contained in a document.  Inverted index: both sides are
    exploded to (id, shingle) and equi-joined on the shingle, so only pairs
    sharing a shingle are ever formed; the verification is exact (no
    MinHash sampling)."""
    d = (docs.select("doc_id", tokens_lower(col("text")).alias("_t"))
         .select("doc_id", F.explode_outer(shingles(col("_t"), n)).alias("sh")).where("sh IS NOT NULL"))
    p = (passages.select("item_id", tokens_lower(col("text")).alias("_t"))
         .select("item_id", shingles(col("_t"), n).alias("_s")))
    psize = p.select("item_id", F.size("_s").alias("p_shingles"))
    pe = p.select("item_id", F.explode("_s").alias("sh"))
    shared = d.join(pe, "sh").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    return (shared.join(psize, "item_id")
            .withColumn("containment", F.round(col("shared") / col("p_shingles"), 4))
            .where(col("shared") / col("p_shingles") >= threshold)
            .select("doc_id", "item_id", "shared", "containment"))


def _d_grams(table: str, key: str) -> str:
    """Distinct 3-grams (key, sh): tokens by position, two successors each."""
    return f"""SELECT DISTINCT {key}, sh FROM (SELECT
  {key}, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS sh
  FROM (SELECT {key}, generate_subscripts(ws, 1) AS pos, unnest(ws) AS x
        FROM (SELECT {key}, list_transform(regexp_extract_all(text, '{WORD_LETTERS}'), lambda y: lower(y)) AS ws
              FROM {table}) a) b
  WINDOW o AS (PARTITION BY {key} ORDER BY pos)) grams WHERE sh IS NOT NULL"""


@register("value_match_jaccard", f"""
WITH d AS ({_d_grams('documents', 'doc_id')}),
p AS ({_d_grams('benchmark', 'item_id')}),
n AS (SELECT item_id, COUNT(*) AS size FROM p GROUP BY item_id)
SELECT doc_id, item_id, COUNT(*) AS shared, ROUND(COUNT(*) / ANY_VALUE(size), 4) AS containment
FROM d JOIN p USING (sh) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING COUNT(*) / ANY_VALUE(size) >= 0.5""")
def value_match_jaccard(spark, sf):
    t = Tables(spark, sf)
    return containment_matches(t.documents, t.benchmark)


# ---------------------------------------------------------------- D-24 / G8
CATALOG_COLUMNS = sorted({c for _, c, _, _ in STAR_CATALOG})


def best_fuzzy(word: Column, names: list[str], cutoff: float = 0.8) -> Column:
    """Best catalog name by edit ratio 1 - lev / max(len) (ties: name
    order); NULL under ``cutoff``.  The name list is the schema's column
    list (fixed and small), scored as an array per word."""
    cand = F.array(*[F.lit(n) for n in names])
    scored = F.transform(cand, lambda n: F.struct(
        (-(F.lit(1.0) - F.levenshtein(word, n) / F.greatest(F.length(word), F.length(n)))).alias("neg"),
        n.alias("name")))
    best = F.element_at(F.array_sort(scored), 1)
    return F.when(-best["neg"] >= cutoff, F.struct(best["name"].alias("name"), (-best["neg"]).alias("ratio")))


_COLS_LIST = "[" + ", ".join(f"'{c}'" for c in CATALOG_COLUMNS) + "]"


@register("fuzzy_match", f"""
WITH w AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(sql, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1),
                                                 lambda r: lower(r))) AS word FROM ex),
s AS (SELECT word, c AS name, 1.0 - levenshtein(word, c) / greatest(length(word), length(c)) AS ratio
      FROM w, (SELECT unnest({_COLS_LIST}) AS c) cs),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, name) AS rn FROM s)
SELECT word, CASE WHEN ratio >= 0.8 THEN name END AS matched_column,
       CASE WHEN ratio >= 0.8 THEN ROUND(ratio, 4) END AS ratio
FROM b WHERE rn = 1""")
def fuzzy_match(spark, sf):
    from fiscus.operators.corpus import query_log, with_sql
    w = (with_sql(query_log(Tables(spark, sf))).select(F.explode(T.words(col("sql"))).alias("word"))
         .distinct())
    m = best_fuzzy(col("word"), CATALOG_COLUMNS)
    return w.select("word", m["name"].alias("matched_column"), F.round(m["ratio"], 4).alias("ratio"))


_VARIANTS = ("word", "concat(substring(word, 1, 2), substring(word, 4))", "concat(word, 's')", "concat(substring(word, 3), substring(word, 1, 2))")


@register("fuzzy_match_blocks", f"""
WITH RECURSIVE w AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(sql, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1),
                                                           lambda r: lower(r))) AS word FROM ex),
v AS (SELECT DISTINCT unnest([{", ".join(_VARIANTS)}]) AS word FROM w),
pairs AS (SELECT word, name FROM v, (SELECT unnest({_COLS_LIST}) AS name) c
          WHERE 2.0 * least(length(word), length(name)) >= 0.8 * (length(word) + length(name))),
cut(word, name, x, y, k) AS (
  SELECT word, name, name, word, 0 FROM pairs
  UNION ALL
  SELECT word, name, unnest([substr(x, 1, i - 1), substr(x, i + n)]), unnest([substr(y, 1, j - 1), substr(y, j + n)]), unnest([n, 0])
  FROM (SELECT *, instr(y, substr(x, i, n)) AS j
        FROM (SELECT word, name, x, y, CAST(ceil(b / 1000.0) AS INTEGER) AS n, CAST(ceil(b / 1000.0) * 1000 - b AS INTEGER) AS i
              FROM (SELECT word, name, x, y, list_max(flatten([[CASE WHEN instr(y, substr(x, p, l)) > 0 THEN l * 1000 - p ELSE 0 END
                                                               FOR l IN range(1, length(x) - p + 2)] FOR p IN range(1, length(x) + 1)])) AS b
                    FROM cut WHERE x <> '' AND y <> '') f) g
        WHERE n > 0) h),
s AS (SELECT word, name, 2.0 * SUM(k) / (length(word) + length(name)) AS ratio FROM cut GROUP BY word, name),
best AS (SELECT word, name, ratio FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, name DESC) AS rn FROM s WHERE ratio >= 0.8) r WHERE rn = 1)
SELECT v.word, best.name AS matched_column, ROUND(CAST(best.ratio AS DOUBLE), 4) AS ratio FROM v LEFT JOIN best USING (word)""")
def fuzzy_match_blocks(spark, sf):
    """G8 / D-24 by matching blocks: names in the log's statements, as they are and with slips (a letter left out,
    one too many, the beginning at the end), against the schema's columns."""
    from fiscus.functions.blocks import best_block_match
    from fiscus.operators.corpus import query_log, with_sql
    words = (with_sql(query_log(Tables(spark, sf))).select(F.explode(T.words(col("sql"))).alias("word")).distinct()
             .select(F.explode(F.array(*[F.expr(v) for v in _VARIANTS])).alias("word")).distinct())
    return (words.select("word", best_block_match(col("word"), CATALOG_COLUMNS).alias("m"))
            .select("word", col("m.name").alias("matched_column"), F.round("m.ratio", 4).alias("ratio")))


def _fix_fuzzy_oracle():
    """The fuzzy keys read the extracted SQL of the query log."""
    from fiscus.operators.corpus_queries import EX_SQL, QL_SQL
    from fiscus.plans.registry import ORACLE
    for key, head in (("fuzzy_match", "WITH "), ("fuzzy_match_blocks", "WITH RECURSIVE ")):
        body = ORACLE[key].strip()
        assert body.startswith(head)
        ORACLE[key] = head + QL_SQL + ",\n" + EX_SQL + ",\n" + body[len(head):]


_fix_fuzzy_oracle()


# ---------------------------------------------------------------- D-38 linking
def _map_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_keys(b), F.lit(0.0).cast("double"),
                       lambda acc, k: acc + F.coalesce(F.element_at(a, k), F.lit(0.0)) * F.element_at(b, k))


def _map_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v * v))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors held as map<token, weight>."""
    return F.try_divide(_map_dot(a, b), F.nullif(_map_norm(a) * _map_norm(b), F.lit(0.0)))


def tfidf_link(questions: DataFrame, items: DataFrame, k: int = 3, threshold: float = 0.1) -> DataFrame:
    """D-38: TF-IDF schema linking.  Items (catalog ``table.column`` names,
    tokens split on '.' and '_') are the documents: idf = ln(N_items / df).
    Each question gets tf x idf weights over the item vocabulary; items with
    cosine >= ``threshold`` are ranked, top ``k`` kept.  Items are a schema's
    names: their words go to every task, and words of questions that no item
    has leave before anything is grouped."""
    it = items.select("item_id", "item", F.explode(F.split(F.regexp_replace("item", r"\.", "_"), "_")).alias("t"))
    n_items = items.agg(F.count(F.lit(1)).alias("N"))
    df_ = it.select("item_id", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = attach_scalar(df_, n_items).select("t", F.log(col("N") / col("df")).alias("idf"))
    tf_i = it.groupBy("item_id", "t").agg(F.count(F.lit(1)).alias("c")).join(
        it.groupBy("item_id").agg(F.count(F.lit(1)).alias("len")), "item_id")
    ivec = (tf_i.join(idf, "t").groupBy("item_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("t", (col("c") / col("len") * col("idf"))
                                                           .alias("w")))).alias("vec")))
    qt = spread(questions.select("id", "question")).select("id", F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), 0).alias("_t"))
    qtok = qt.select("id", F.size("_t").alias("len"), F.explode("_t").alias("t"))
    qvec = (qtok.join(F.broadcast(idf), "t")
            .groupBy("id", "t").agg(F.count(F.lit(1)).alias("c"), F.first("len").alias("len"), F.first("idf").alias("idf"))
            .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(
                "t", (col("c") / col("len") * col("idf")).alias("w")))).alias("qvec")))
    top = topk_items(qvec, "id", "qvec", ivec, "item_id", "vec", k, tfidf_cosine, min_score=threshold)
    return (top.join(F.broadcast(items.select("item_id", "item")), "item_id")
            .select("id", col("rank").cast("int"), "item", F.round("score", 6).alias("score")))


@register("tfidf_link", f"""
WITH {_CAT_ITEMS_SQL},
it AS (SELECT item_id, unnest(string_split(replace(item, '.', '_'), '_')) AS t FROM items),
idf AS (SELECT t, ln((SELECT COUNT(*) FROM items) / COUNT(DISTINCT item_id)) AS idf FROM it GROUP BY t),
iw AS (SELECT it.item_id, it.t, COUNT(*) / MAX(l.len) * MAX(idf.idf) AS w
       FROM it JOIN (SELECT item_id, COUNT(*) AS len FROM it GROUP BY item_id) l ON it.item_id = l.item_id
       JOIN idf ON it.t = idf.t GROUP BY it.item_id, it.t),
qs AS (SELECT p_partkey AS id, regexp_extract_all(lower({QUESTION_SQL}), '[a-z0-9]+') AS toks FROM part),
qt AS (SELECT id, len(toks) AS len, unnest(toks) AS t FROM qs),
qw AS (SELECT qt.id, qt.t, COUNT(*) / MAX(qt.len) * MAX(idf.idf) AS w
       FROM qt JOIN idf ON qt.t = idf.t GROUP BY qt.id, qt.t),
qn AS (SELECT id, sqrt(SUM(w * w)) AS n FROM qw GROUP BY id),
inn AS (SELECT item_id, sqrt(SUM(w * w)) AS n FROM iw GROUP BY item_id),
dot AS (SELECT qw.id, iw.item_id, SUM(qw.w * iw.w) AS d FROM qw JOIN iw ON qw.t = iw.t GROUP BY qw.id, iw.item_id),
s AS (SELECT dot.id, dot.item_id, d / NULLIF(qn.n * inn.n, 0) AS score
      FROM dot JOIN qn ON dot.id = qn.id JOIN inn ON dot.item_id = inn.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item_id) AS rank FROM s WHERE score >= 0.1)
SELECT r.id, CAST(rank AS INTEGER) AS rank, items.item, ROUND(score, 6) AS score
FROM r JOIN items ON r.item_id = items.item_id WHERE rank <= 3""")
def tfidf_link_q(spark, sf):
    from fiscus.operators.corpus import query_log
    questions = query_log(Tables(spark, sf)).select("id", "question")
    return tfidf_link(questions, catalog_items(spark).select("item_id", "item"))
