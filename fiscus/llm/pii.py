"""Personal data with DataFrame operations only: fixed patterns, and
information-theoretic sanitisation.

Spans of the base kinds are found by patterns and checks.  Their values are
the protected entities.  Over the whole corpus, the words near an entity are
counted against their document frequency: a word whose pointwise mutual
information with an entity comes near the entity's own information content
discloses it.  Such words are removed wherever they stand, also in documents
that do not name the entity, or generalised if they disclose it less.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fiscus.llm.common import keyed, maybe_in, written

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the kinds, leftmost and greedy.  Runs are possessive and may
# start only at their first character or where the last match ended: no other
# start could match longer or earlier, and no text makes the search quadratic.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]++"


@dataclass(frozen=True)
class Disclosure:
    """A word within ``near`` words of an entity discloses it when
    PMI(word; entity) >= ``generalise`` of the entity's information content,
    fully from ``remove`` on."""

    generalise: float = 0.85
    remove: float = 0.95
    near: int = 5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, v: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.char_length(digits)
    return (F.when(kind == 1, v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
            .when(kind == 2, F.when(n.between(14, 19), luhn(digits)).otherwise(False))
            .when(kind == 3, n.between(10, 15)).otherwise(True))


def words(t: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.transform(F.regexp_extract_all(t, F.lit(TERM), F.lit(0)), F.lower)


def _cut(t: Column, pattern: str) -> Column:
    """Matches v of the pattern in order, each with the length of the text
    between it and the match before."""
    gaps, found = F.split(t, F.lit(pattern), -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    # the array of one binds the gaps, so they are computed once
    return F.transform(F.array(gaps), lambda g: F.transform(found, lambda v, i: F.struct(
        F.char_length(F.get(g, i)).alias("gap"), v.alias("v"))))[0]


def _once(x: DataFrame, *columns: str) -> DataFrame:
    """One row of ``x`` for each text, as rows that repeat id and text are
    equal.  All windows of a text (k1, k2, and more) run where this leaves it:
    texts are moved, their words and matches never.  The second move is to twice
    the partitions of a shuffle, as words take many times the room of the texts:
    Spark merges small partitions after the first move, and would leave out a
    second one to as many."""
    x = x.groupBy("k1", "k2").agg(F.first(F.struct(*columns)).alias("x")).select("k1", "k2", "x.*")
    return x.repartition(2 * int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k1", "k2")


def _placed(found: DataFrame, *more: str) -> DataFrame:
    """Start and end (code points, end exclusive) of each match.  The rows of
    one text and kind are summed in order."""
    w = W.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.char_length("v")
    end = F.sum(F.col("gap") + size).over(w)
    return found.select("k1", "k2", "kind", "v", (end - size).alias("s"), end.alias("e"), *more)


def base_spans(d: DataFrame, near: int) -> DataFrame:
    """(k1, k2, kind, v, s, e, before, after) of the base kinds that pass their
    check, with the ``near`` words of the text before and behind them.

    Words are placed like matches, as kind 4, in texts with a span; a word
    counts if it ends before the span or starts behind it, whatever stands
    between (other matches, valid or not).
    """
    t = F.col("t")
    some = {"email": F.instr(t, "@") > 0, "phone": F.instr(t, "+") > 0}
    kinds = F.array(*[F.when(some.get(k, F.lit(True)) & t.rlike(p), F.struct(F.lit(i).alias("kind"), _cut(t, p).alias("cuts")))
                      for i, (k, p) in enumerate(PATTERNS.items())])
    kinds = F.filter(kinds, lambda x: F.exists(x["cuts"], lambda c: valid(x["kind"], c["v"])))
    x = d.where(t.rlike("[0-9@]")).select("k1", "k2", "t", F.explode(F.array(kinds)).alias("kinds")).where(F.size("kinds") > 0)
    x = _once(x, "t", "kinds")
    x = x.select("k1", "k2", F.explode(F.concat("kinds", F.array(F.struct(F.lit(4).alias("kind"), _cut(t, TERM).alias("cuts"))))).alias("x"))
    x = x.select("k1", "k2", "x.kind", F.posexplode("x.cuts").alias("i", "c")).select("k1", "k2", "kind", "i", "c.*")
    word = F.col("kind") == 4
    x = _placed(x).where(word | valid(F.col("kind"), F.col("v")))
    text, line = W.partitionBy("k1", "k2"), W.partitionBy("k1", "k2", "kind").orderBy("s")
    low = F.lower("v")
    x = x.withColumn("before", F.collect_list(low).over(line.rowsBetween(1 - near, 0))).withColumn(
        "after", F.collect_list(low).over(line.rowsBetween(0, near - 1)))
    # a word is met at its end on the way forward, at its start on the way back, and before a span there
    first = F.when(word, 0).otherwise(1)
    forward = text.orderBy(F.when(word, F.col("e")).otherwise(F.col("s")), first).rowsBetween(W.unboundedPreceding, 0)
    back = text.orderBy(F.when(word, F.col("s")).otherwise(F.col("e")).desc(), first).rowsBetween(W.unboundedPreceding, 0)
    none = F.array().cast("array<string>")
    last = lambda c, w: F.coalesce(F.last(F.when(word, F.col(c)), ignorenulls=True).over(w), none).alias(c)
    x = x.select("k1", "k2", "kind", "v", "s", "e", last("before", forward), last("after", back))
    return x.where(F.col("kind") < 4)


def _among(x: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``x`` whose term may be one of ``terms``: the other words of
    the corpus are not moved to meet them."""
    h = F.xxhash64("term")
    return maybe_in(x, h, terms.select(h)).where("maybe").drop("maybe")


def disclosing_terms(d: DataFrame, spans: DataFrame, limits: Disclosure) -> DataFrame:
    """(entity, term, share): words that disclose an entity, and the share of
    its information content that they give away.

    With N documents, df(c), df(t) and df(c, t) those that hold the entity,
    the word, and the word near the entity: information content =
    log N / df(c), and PMI = log p / (df(c) / N), where
    p = (df(c, t) + df(c) / N) / (df(t) + 1) is the share of the word's
    documents that have it near the entity, with one document more at the
    entity's own rate.  So few documents weigh less than many, without a least
    number.  All counts cover all documents.
    """
    c = spans.select("k1", "k2", F.concat_ws(":", "kind", F.lower("v")).alias("entity"),
                     F.concat("before", "after").alias("words"))
    entity = c.select("entity", "k1", "k2").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("dc"))
    pair = c.select("entity", "k1", "k2", F.explode("words").alias("term")).distinct()
    pair = pair.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("dct"))
    pair = written(pair.join(entity, "entity"), "near-entities")
    seen = d.select(F.explode(F.array_distinct(words(F.col("t")))).alias("term"))
    seen = _among(seen, pair).groupBy("term").agg(F.count(F.lit(1)).alias("dt"))
    n = d.count()
    rate = F.col("dc") / F.lit(float(n))
    pmi = F.log2((F.col("dct") + rate) / (F.col("dt") + 1) / rate)
    out = pair.join(seen, "term").where(F.col("dc") < n).select("entity", "term", (pmi / -F.log2(rate)).alias("share"))
    return out.where(F.col("share") >= limits.generalise)


def term_spans(d: DataFrame, terms: DataFrame) -> DataFrame:
    """Spans of disclosing words in all documents that hold them; a word that
    discloses several entities has the largest share.

    Documents meet terms by their distinct words.  A term is in at most
    (documents near its entity / the least p) documents, so the rows that
    meet stay in proportion to the words near entities.  The terms of a
    document then lie behind its words, where they move none of them, and
    give their share to the equal ones.
    """
    terms = written(terms.groupBy("term").agg(F.max("share").alias("share")), "disclosing-words")
    held = d.select("k1", "k2", F.explode(F.array_distinct(words(F.col("t")))).alias("term"))
    held = _among(held, terms).join(terms, "term")
    held = written(held.groupBy("k1", "k2").agg(F.collect_set(F.struct("term", "share")).alias("terms")), "documents-with-terms")
    x = _once(d.select("k1", "k2", "t").join(held, ["k1", "k2"]), "t", "terms")
    none, behind = F.lit(None).cast("double").alias("own"), F.lit(2**31 - 1).alias("i")
    of_text = F.transform(_cut(F.col("t"), TERM), lambda c, i: F.struct(i.alias("i"), c["gap"].alias("gap"), c["v"].alias("v"), none))
    of_terms = F.transform("terms", lambda c: F.struct(behind, F.lit(0).alias("gap"), c["term"].alias("v"), c["share"].alias("own")))
    x = x.select("k1", "k2", F.lit(4).alias("kind"), F.explode(F.concat(of_text, of_terms)).alias("x")).select("k1", "k2", "kind", "x.*")
    x = _placed(x, "own").withColumn("term", F.when(F.col("own").isNull(), F.lower("v")).otherwise(F.col("v")))
    x = x.withColumn("share", F.max("own").over(W.partitionBy("k1", "k2", "term")))
    return x.where(F.col("own").isNull() & F.col("share").isNotNull())


def spans_by_row(docs: DataFrame, limits: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, found) of each row key (see ``keyed``) with spans: found lists
    (s, kind, e, share) by start, then kind as in KINDS; share is null for base
    kinds.  Words that overlap a base span are left out: the base span stays.
    Written to scratch; the spans of a text are bounded by its length."""
    d = keyed(docs, id_col, text_col)
    spans = written(base_spans(d, limits.near), "spans")
    terms = written(disclosing_terms(d, spans, limits), "terms")
    share = F.lit(None).cast("double").alias("share")
    both = spans.select("k1", "k2", "s", "kind", "e", share).unionByName(
        term_spans(d, terms).select("k1", "k2", "s", "kind", "e", "share"))
    both = both.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("s", "kind", "e", "share"))).alias("found"))
    base = F.filter("found", lambda x: x["kind"] < 4)
    clear = F.filter("found", lambda x: (x["kind"] < 4) | ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    both = both.withColumn("found", F.when(F.exists("found", lambda x: x["kind"] == 4), clear).otherwise(F.col("found")))
    return written(both, "all-spans")


def find(docs: DataFrame, limits: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and found (see ``spans_by_row``; null if
    there are none).  Null and empty texts have no spans; rows that repeat id
    and text have the same; null ids are allowed; extra columns are ignored."""
    d = keyed(docs, id_col, text_col).drop("t")
    return d.join(spans_by_row(docs, limits, id_col, text_col), ["k1", "k2"], "left")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of ``find``."""
    none = F.coalesce("found", F.array().cast("array<struct<s:bigint,kind:int,e:bigint,share:double>>"))
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(a):
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"], x["e"])), ",")

    f = found.select(F.col("id").alias(id_col), none.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return f.select(id_col, *counts, F.sha2(joined(F.filter("found", lambda x: x["kind"] < 4)), 256).alias("base_sha256"),
                    joined(F.col("found")).alias("spans"))


def sanitised(t: Column, found: Column, remove: float) -> Column:
    """The text with [EMAIL], [IP], [CARD], [PHONE] for base spans, [WORD] for
    generalised words, and nothing for removed ones.  Spans that overlap are
    replaced together, by the first one's label."""
    start = F.array().cast("array<struct<s:bigint,kind:int,e:bigint,share:double>>")
    merged = F.aggregate(found, start, lambda a, x: F.when(
        (F.size(a) > 0) & (x["s"] < F.get(a, F.size(a) - 1)["e"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
            F.get(a, F.size(a) - 1)["s"].alias("s"), F.get(a, F.size(a) - 1)["kind"].alias("kind"),
            F.greatest(F.get(a, F.size(a) - 1)["e"], x["e"]).alias("e"), F.get(a, F.size(a) - 1)["share"].alias("share")))))
        .otherwise(F.concat(a, F.array(x))))
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit("[WORD]"))
    parts = F.transform(F.array(merged), lambda m: F.concat(F.transform(m, lambda x, i: F.concat(
        F.substring(t, (F.coalesce(F.get(m, i - 1)["e"], F.lit(0)) + 1).cast("int"),
                    (x["s"] - F.coalesce(F.get(m, i - 1)["e"], F.lit(0))).cast("int")),
        F.when(x["share"] >= remove, "").otherwise(F.get(label, x["kind"])))),
        F.array(F.substring(t, (F.get(m, F.size(m) - 1)["e"] + 1).cast("int"), F.lit(2**31 - 1)))))[0]
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.array_join(parts, "")).otherwise(t)
