"""Sparse top-k (D-31, D-38) by postings with max-score pruning.

A term's postings carry the largest weight any item gives it, which bounds what
the term can add to a score.  The rarest terms of a question give its k-th best
score from below; terms that together stay under it cannot lift an item into
the top k alone, so their postings are never walked: they only complete the
scores of items that the other terms found.  The result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiscus.functions.vectors import sigmoid
from fiscus.operators.retrieval import WORD_LETTERS, catalog_items, tokens_lower
from fiscus.plans.analytics import attach_scalar
from fiscus.plans.registry import ORACLE, register
from fiscus.session import written
from fiscus.sources.tables import Tables

col = F.col

#: postings of a term that one task walks; a term with more is cut into parts
POSTINGS_PER_PART = 50_000
#: terms of a question, the rarest, whose postings give the bound
SEED_TERMS = 3
#: scores are compared at this many digits: sums in any order give the same ranks
DIGITS = 9
_SLACK = 2 * 10.0 ** -DIGITS
#: rows, of a few numbers and a word, that each task may hold whole
ROWS_SENT = 100_000


def is_short(rows: DataFrame) -> bool:
    """Whether ``rows``, read from a file, are at most ``ROWS_SENT``."""
    return rows.limit(ROWS_SENT + 1).count() <= ROWS_SENT


def whole_if(short: bool, rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join: whole in each task if they were counted
    to be short, else merged.  File sizes do not tell: words that repeat and
    lists that are exploded measure little."""
    return F.broadcast(rows) if short else rows.hint("merge")


class Postings:
    """Items (iid, term, iw > 0) and questions (qid, term, qw > 0), one row
    per term each, held against one another term by term."""

    def __init__(self, questions: DataFrame, items: DataFrame, part_rows: int = POSTINGS_PER_PART):
        words = written(questions.select("term").distinct(), "asked-words")
        rows = written(items.join(whole_if(is_short(words), words), "term", "left_semi").select("iid", "term", "iw"), "postings")
        stats = written(rows.groupBy("term").agg(F.max("iw").alias("top"), F.count(F.lit(1)).alias("df"))
                        .withColumn("parts", F.ceil(col("df") / part_rows).cast("int")), "terms")
        few = is_short(stats)
        asked = questions.join(whole_if(few, stats), "term").withColumn("gain", col("qw") * col("top"))
        self.asked = written(asked, "asked-terms")
        self.rows = rows.join(whole_if(few, stats.select("term", "parts")), "term").select(
            "iid", "term", "iw", F.pmod(F.xxhash64("iid"), col("parts")).cast("int").alias("part"))
        self.short_rows, self.short_asked = is_short(rows), is_short(self.asked)

    def hits(self, asked: DataFrame) -> DataFrame:
        """(qid, iid, add) for each posting of the asked terms; a term of many parts is asked in each."""
        dealt = asked.select("qid", "term", "qw", F.explode(F.sequence(F.lit(0), col("parts") - 1)).alias("part"))
        if self.short_asked and not self.short_rows:
            both = self.rows.join(F.broadcast(dealt), ["term", "part"])
        else:
            both = dealt.join(whole_if(self.short_rows, self.rows), ["term", "part"])
        return both.select("qid", "iid", (col("qw") * col("iw")).alias("add"))

    def bounds(self, k: int, seeds: int = SEED_TERMS) -> DataFrame:
        """(qid, least): the k-th best score that the rarest terms alone reach; questions that reach fewer items have no row."""
        rarest = Window.partitionBy("qid").orderBy("df", "term")
        some = self.hits(self.asked.withColumn("r", F.row_number().over(rarest)).where(col("r") <= seeds))
        best = Window.partitionBy("qid").orderBy(col("s").desc())
        return (some.groupBy("qid", "iid").agg(F.sum("add").alias("s")).withColumn("r", F.row_number().over(best))
                .where(col("r") <= k).groupBy("qid").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("n"))
                .where(col("n") == k).select("qid", "least"))

    def split(self, k: int, seeds: int = SEED_TERMS) -> DataFrame:
        """Asked terms with ``needed``: whether their postings must be walked;
        ``least``; and ``rest``, the most that the terms not walked can add."""
        upto = Window.partitionBy("qid").orderBy("gain", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = self.asked.join(self.bounds(k, seeds).hint("merge"), "qid", "left").withColumn("upto", F.sum("gain").over(upto))
        d = d.withColumn("needed", col("least").isNull() | (col("upto") >= col("least") - _SLACK))
        rest = F.sum(F.when(~col("needed"), col("gain")).otherwise(0.0)).over(Window.partitionBy("qid"))
        return d.withColumn("rest", rest).drop("upto")


def sparse_topk(questions: DataFrame, items: DataFrame, k: int, part_rows: int = POSTINGS_PER_PART,
                seeds: int = SEED_TERMS) -> DataFrame:
    """(qid, rank, iid, score): the ``k`` items with the largest sum of
    qw * iw over shared terms, scores rounded to ``DIGITS``, ties by item id.
    Items that share no term with a question are no answer to it."""
    p = Postings(questions, items, part_rows)
    asked = written(p.split(k, seeds), "split-terms")
    found = p.hits(asked.where("needed")).groupBy("qid", "iid").agg(F.sum("add").alias("s"))
    limit = asked.groupBy("qid").agg(F.max("least").alias("least"), F.max("rest").alias("rest"))
    kept = written(found.join(limit.hint("merge"), "qid").where(col("least").isNull() | (col("s") + col("rest") >= col("least") - _SLACK))
                   .select("qid", "iid", "s"), "candidates")
    more = (kept.select("qid", "iid").join(whole_if(p.short_asked, asked.where(~col("needed")).select("qid", "term", "qw")), "qid")
            .join(whole_if(p.short_rows, p.rows.select("iid", "term", "iw")), ["iid", "term"]).select("qid", "iid", (col("qw") * col("iw")).alias("s")))
    score = (kept.unionByName(more).groupBy("qid", "iid").agg(F.round(F.sum("s"), DIGITS).alias("score")))
    w = Window.partitionBy("qid").orderBy(col("score").desc(), "iid")
    return score.withColumn("rank", F.row_number().over(w)).where(col("rank") <= k).select("qid", "rank", "iid", "score")


# ---------------------------------------------------------------- D-31
@register("topk_token_overlap_pruned", ORACLE["topk_token_overlap"])
def topk_token_overlap_pruned(spark, sf):
    """The rows of ``topk_token_overlap`` from postings: an item's tokens weigh 1 / their number."""
    from fiscus.operators.corpus import query_log
    asked = query_log(Tables(spark, sf)).select(
        col("id").alias("qid"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9_]+"), 0))).alias("term"),
        F.lit(1.0).alias("qw"))
    items = catalog_items(spark)
    weights = items.select(col("item_id").alias("iid"), F.explode("tokens").alias("term"), (F.lit(1.0) / F.size("tokens")).alias("iw"))
    top = sparse_topk(asked, weights, 3).join(F.broadcast(items.select(col("item_id").alias("iid"), "item")), "iid")
    return top.select(col("qid").alias("id"), "rank", "item", F.round("score", 6).alias("score"),
                      F.round(sigmoid(4 * col("score") - 2), 6).alias("probability"))


# ---------------------------------------------------------------- D-38
def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n): the words of each text, counted."""
    return (texts.select(col(id_col).alias("id"), F.explode_outer(tokens_lower(col(text_col))).alias("term"))
            .where("term IS NOT NULL").groupBy("id", "term").agg(F.count(F.lit(1)).alias("n")))


def unit_tfidf(counts: DataFrame, idf: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, term, w): n * idf over the length of that vector; weights of 0 are
    left out, and so are terms that are not ``asked``."""
    raw = counts.join(idf, "term").select("id", "term", (col("n") * col("idf")).alias("w")).where("w > 0")
    size = raw.groupBy("id").agg(F.sqrt(F.sum(col("w") * col("w"))).alias("size"))
    kept = raw if asked is None else raw.join(asked, "term", "left_semi")
    return kept.join(size.hint("merge"), "id").select("id", "term", (col("w") / col("size")).alias("w"))


def tfidf_passages(docs: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents closest to each
    passage by TF-IDF cosine, idf = ln(documents / documents with the term)."""
    counts = written(term_counts(docs, "doc_id", "text"), "term-counts")
    idf = attach_scalar(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), docs.agg(F.count(F.lit(1)).alias("N")))
    idf = written(idf.select("term", F.log(col("N") / col("df")).alias("idf")), "idf")
    idf = whole_if(is_short(idf), idf)
    asked = written(unit_tfidf(term_counts(passages, "item_id", "text"), idf), "asked")
    words = written(asked.select("term").distinct(), "words")
    items = unit_tfidf(counts, idf, whole_if(is_short(words), words)).select(col("id").alias("iid"), "term", col("w").alias("iw"))
    asked = asked.select(col("id").alias("qid"), "term", col("w").alias("qw"))
    return sparse_topk(asked, items, k).select(col("qid").alias("item_id"), "rank", col("iid").alias("doc_id"), "score")


def _counted(table: str, key: str) -> str:
    return f"""SELECT id, term, COUNT(*) AS n FROM (
      SELECT {key} AS id, unnest(list_transform(regexp_extract_all(text, '{WORD_LETTERS}'), lambda x: lower(x))) AS term
      FROM {table}) x GROUP BY id, term"""


@register("tfidf_passage_topk", f"""
WITH dc AS MATERIALIZED ({_counted('documents', 'doc_id')}),
idf AS (SELECT term, ln((SELECT COUNT(*) FROM documents) / COUNT(*)) AS idf FROM dc GROUP BY term),
dw AS (SELECT id, term, n * idf AS w FROM dc JOIN idf USING (term)),
pw AS (SELECT id, term, n * idf AS w FROM ({_counted('benchmark', 'item_id')}) p JOIN idf USING (term)),
dn AS (SELECT id, sqrt(SUM(w * w)) AS size FROM dw GROUP BY id),
pn AS (SELECT id, sqrt(SUM(w * w)) AS size FROM pw GROUP BY id),
s AS (SELECT pw.id AS item_id, dw.id AS doc_id, ROUND(SUM(pw.w / pn.size * dw.w / dn.size), {DIGITS}) AS score
      FROM pw JOIN dw ON pw.term = dw.term AND pw.w > 0 AND dw.w > 0 JOIN pn ON pn.id = pw.id JOIN dn ON dn.id = dw.id
      GROUP BY pw.id, dw.id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, ROUND(score, 6) AS score FROM r WHERE rank <= 5""")
def tfidf_passage_topk(spark, sf):
    t = Tables(spark, sf)
    return tfidf_passages(t.documents, t.benchmark, 5).withColumn("score", F.round("score", 6))
