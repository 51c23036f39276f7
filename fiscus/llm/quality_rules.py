"""Quality rules with DataFrame operations only.

Lines are normalised and hashed; per host the distinct documents that hold a
line are counted; lines held by more than a share of a host's documents are
removed, and documents that keep too little are rejected.  Base statistics
are computed row by row; nothing but (host, line hash, text hash) is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import text_or_empty, written

BLANK = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineLimits:
    """A line is removed from a host's documents when more than ``share`` of
    the host's distinct texts, and at least ``least`` of them, hold it.  A
    document is rejected when fewer than ``rest`` of its words are left."""

    share: float = 0.10
    least: int = 20
    rest: float = 0.5


def words_of(t: Column) -> Column:
    """The words of a text: runs without U+0020 and U+0009-U+000D."""
    bare = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, blanks as one space, none at the ends."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), BLANK + "+", " ")
    return F.btrim(flat)


def normal_lines(t: Column) -> Column:
    """Normalised lines with a word, in order."""
    return F.filter(F.transform(F.split(t, "\n"), normal_line), lambda x: x != "")


def dup_lines(t: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    kept = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return F.size(kept).cast("long") - F.size(F.array_distinct(kept))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Window hashes are compared; only texts whose hashes repeat are sorted to
    find where.  A window at p covers p..p+2, so it adds min(3, gap to the
    next repeated window) words.
    """
    none = F.lit(0).cast("long")
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2),
                        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    return F.when(F.size(w) < 4, none).otherwise(
        let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(_covered(g))))


def _covered(g: Column) -> Column:
    placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

    def repeated(s):
        return F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))

    at = let(placed, lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
    return let(at, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


def base_statistics(t: Column, w: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text
    (not null) with words ``w``."""
    return [
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, BLANK, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words")]


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, limits: LineLimits) -> DataFrame:
    """(host, lines): per host the hashes of the lines above the limits.

    Distinct texts are counted, so exact copies of a document count once.  At
    most (lines per document / share) lines of a host pass, so the array is
    bounded by the length of documents, not by their number.
    """
    d = docs.select(F.col(f"`{host_col}`").cast("string").alias("host"), text_or_empty(text_col).alias("t"))
    d = d.select("host", F.xxhash64("t").alias("x"),
                 F.array_distinct(F.transform(normal_lines(F.col("t")), lambda s: F.xxhash64(s))).alias("lines"))
    held = d.select("host", "x", F.explode("lines").alias("line")).distinct()
    n_line = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limits.least)
    n_host = d.select("host", "x").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    n_host = n_host.select(F.col("host").alias("host2"), "docs")
    over = n_line.join(n_host, F.col("host").eqNullSafe(F.col("host2"))).where(F.col("n") > limits.share * F.col("docs"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """``docs`` with a struct ``quality``: the base statistics, clean_text (the
    text without frequent lines; null stays null), n_words_left, n_lines_removed,
    depleted and kept.

    Null text counts as empty (no words: base_failed).  Null hosts form one
    host.  Repeated rows each get a verdict; their text counts once.  All other
    columns pass through, whatever their names.  An empty table gives no rows.
    The list of frequent lines is written to scratch first, so Spark knows its
    size when it picks the join.
    """
    hot = written(frequent_lines(docs, text_col, host_col, limits), "frequent-lines")
    hot = hot.select(F.col("host").alias("hot_host"), F.col("lines").alias("hot_lines"))
    t, lines = F.col("t"), F.col("hot_lines")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(text_col).alias("t"),
                      F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").isNull().alias("no_text"))
    row = row.join(hot, F.col("host").eqNullSafe(F.col("hot_host")), "left")
    frequent = lambda s: let(normal_line(s), lambda x: (x != "") & F.array_contains(lines, F.xxhash64(x)))
    left = F.when(lines.isNotNull(), F.filter(F.split(t, "\n"), lambda s: ~frequent(s)))
    # the generators keep the optimizer from copying these expressions into filters
    row = row.select("row", "t", "no_text", F.explode(F.array(let(words_of(t), lambda w: F.struct(*base_statistics(t, w))))).alias("b"),
                     "hot_lines")
    row = row.select("row", "t", "no_text", "b", F.explode(F.array(let(left, lambda x: F.struct(
        F.when(x.isNull(), t).otherwise(F.array_join(x, "\n")).alias("clean"),
        F.when(x.isNull(), F.lit(None)).otherwise(F.size(words_of(F.array_join(x, "\n")))).cast("long").alias("words"),
        F.when(x.isNull(), 0).otherwise(F.size(F.split(t, "\n")) - F.size(x)).cast("long").alias("removed"))))).alias("a"))
    n_left = F.coalesce("a.words", "b.n_words")
    failed = (F.col("b.n_words") < 50) | (100 * F.col("b.n_repeat_words") > 50 * F.col("b.n_words"))
    depleted = n_left < limits.rest * F.col("b.n_words")
    stats = F.struct(
        "b.*", failed.alias("base_failed"), F.when(~F.col("no_text"), F.col("a.clean")).alias("clean_text"),
        n_left.alias("n_words_left"), F.col("a.removed").alias("n_lines_removed"), depleted.alias("depleted"),
        (~failed & ~depleted).alias("kept"))
    return row.select("row.*", stats.alias("quality"))
