"""Periodic runs of words, as maximal pairs of the suffix order.

Positions of a text are ordered by what follows them (prefix doubling on word
ids), and the tree of longest-common-prefix intervals is walked bottom up.
Every interval keeps its positions by the word to their left.  Two positions
that meet in an interval of l words and have different left words are a
maximal pair: the l words behind both are equal and neither side can be
extended.  If they are q <= l / (times - 1) words apart, the stretch from the
first to l words behind the second has period q and at least ``times`` of
them, so the pair is a run as it stands.  A text whose shortest admissible
repeat (16 words for runs of 24 words and three periods) occurs once has no
run and gets no tree.  Texts are independent: no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import Words, mix64, ship, span_hash, text_blocks, text_or_empty

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"id long, n_words long, runs array<{RUN}>, collapsed_text string"


def shortest_repeat(least: int, times: int) -> int:
    """The fewest words that two positions of a run, one period apart, share."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def suffix_order(word: np.ndarray, doc: np.ndarray):
    """(rank, levels) of the suffixes of texts laid end to end: ``rank`` orders
    them text by text; ``levels[t]`` is equal for two positions exactly if the
    next 2**t words are (one more entry, never equal, stands behind the end).
    Memory: 4 or 8 bytes a word and level, for as many levels as the longest
    repeat of a text has binary digits."""
    n = len(word)
    end = np.searchsorted(doc, doc, side="right")
    kind = np.int32 if n < 2**31 - 2 else np.int64
    rank = np.full(n + 1, -1, kind)
    order = np.lexsort((word, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    open_ = order[~(new & np.append(new[1:], True))]
    while len(open_):
        behind = open_ + step
        second = np.where(behind < end[open_], rank[behind].astype(np.int64) + 1, 0)
        key = rank[open_].astype(np.int64) * (n + 2) + second
        at = np.argsort(key, kind="stable")
        open_, key = open_[at], key[at]
        old = rank[open_]
        place = np.arange(len(open_))
        group, part = np.ones(len(open_), bool), np.ones(len(open_), bool)
        group[1:], part[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(part, place, 0)) - first
        levels.append(rank)
        step *= 2
        open_ = open_[~(part & np.append(part[1:], True))]
    return rank[:n], levels


def common_prefix(levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b (each a < b or a > b) share."""
    n = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        n += (levels[t][a + n] == levels[t][b + n]).astype(np.int64) << t
    return n


def _joined(node, other, shared: int, least: int, times: int, out: list):
    """Two children of an interval of ``shared`` words as one node; pairs of
    their positions that are runs go to ``out`` as (start, period, shared).
    A node is (sorted positions, {left word: sorted positions}); with one left
    word both are the same list."""
    if len(node[0]) < len(other[0]):
        node, other = other, node
    everything, classes = node
    most, fewest = shared // (times - 1), max(1, least - shared)
    if not (len(classes) == 1 and len(other[1]) == 1 and next(iter(classes)) == next(iter(other[1]))):
        for left, positions in other[1].items():
            for x in positions:
                a, b = bisect_left(everything, x - most), bisect_right(everything, x + most)
                if a == b:
                    continue
                for c, there in classes.items():
                    if c != left:
                        for y in there[bisect_left(there, x - most):bisect_right(there, x + most)]:
                            q = x - y if x > y else y - x
                            if q >= fewest:
                                out.append((min(x, y), q, shared))
    for left, positions in other[1].items():
        if len(classes) == 1 and left not in classes:
            everything = list(everything)
        mine = classes.setdefault(left, [])
        for x in positions:
            insort(mine, x)
            if mine is not everything:
                insort(everything, x)
    return everything, classes


def maximal_pairs(positions: list, shared: list, left: list, least: int, times: int) -> list:
    """(start, period, shared words) of the maximal pairs that are runs.
    ``positions`` in suffix order, ``shared[i]`` words common to the i-th and
    the next (0 ends a stretch of the order), ``left`` the word before each."""
    stack: list = []
    out: list = []
    for x, c, after in zip(positions, left, shared):
        alone = [x]
        node = (alone, {c: alone})
        while stack and stack[-1][0] > after:
            depth, held = stack.pop()
            node = _joined(held, node, depth, least, times, out)
        if stack and stack[-1][0] == after:
            stack[-1][1] = _joined(stack[-1][1], node, after, least, times, out)
        elif after:
            stack.append([after, node])
    return out


def block_runs(words: Words, least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """{text: [(start, length, period)]} of a block, sorted; texts without runs are left out."""
    short = shortest_repeat(least, times)
    hashes, first = words.hashes(), words.first
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(doc)) + short <= first[1:][doc]) if len(doc) else np.zeros(0, np.int64)
    gram = span_hash(hashes, at, at + short) ^ mix64(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(gram)
    twice = order[1:][gram[order[1:]] == gram[order[:-1]]]
    if not len(twice):
        return {}
    some = np.zeros(len(first), bool)
    some[doc[at[twice]]] = True
    picked = np.flatnonzero(some[doc])
    word, doc = np.unique(hashes[picked], return_inverse=True)[1], doc[picked]
    rank, levels = suffix_order(word, doc)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    a, b = order[:-1], order[1:]
    depth = min(short.bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[depth][a] == levels[depth][b])
    shared = np.zeros(len(order), np.int64)
    shared[near] = common_prefix(levels, a[near], b[near])
    shared[shared < short] = 0
    inside = (shared > 0) | np.append(False, shared[:-1] > 0)
    positions = order[inside]
    before = np.where((positions > 0) & (doc[positions - 1] == doc[positions]), word[positions - 1], -1)
    pairs = maximal_pairs(positions.tolist(), shared[inside].tolist(), before.tolist(), least, times)
    best: dict = {}
    for start, q, n in pairs:
        key = (start, start + q + n)
        if q < best.get(key, q + 1):
            best[key] = q  # a multiple of the period gives the same stretch
    out: dict = {}
    for (start, end), q in best.items():
        d = int(doc[start])
        out.setdefault(d, []).append((start - int(np.searchsorted(doc, d)), end - start, q))
    return {d: sorted(v, key=lambda r: (r[0], r[2])) for d, v in out.items()}


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run holds behind its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        drop[start + q] += 1
        drop[start + n] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length and
    smallest period of every maximal stretch of at least ``least`` words and
    ``times`` periods, by start, then period) and collapsed_text (the words
    outside all runs and those of each run's first period that no other run
    drops, joined by one space).

    Words are runs without U+0020, U+0009-U+000D, equal when their 64-bit
    hashes are.  Null and empty texts have no words, no runs and an empty
    collapsed_text; texts of any length are one row of one task; rows that
    repeat an id or a text each get their row; null ids are allowed; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    ship(docs.sparkSession)
    d = docs.select(text_or_empty(text_col).alias("t"), F.col(f"`{id_col}`").cast("long").alias("id"))

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(0), 1 << 20):
                found = block_runs(Words(data, offsets), least, times)
                raw, n_words, runs, texts = data.tobytes(), [], [], []
                for i in range(len(offsets) - 1):
                    words = raw[offsets[i]:offsets[i + 1]].split()
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())])
                    texts.append(b" ".join(collapsed(words, found[i]) if i in found else words).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(row, len(n_words)), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())],
                    ["id", "n_words", "runs", "collapsed_text"])

    return d.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def greatest_run(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: smallest start, then period); null without runs."""

    def order(a, b):
        more = b["length"] * a["period"] - a["length"] * b["period"]
        by = F.when(more != 0, more).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(by).cast("int")

    return F.when(F.size(runs) > 0, F.array_sort(runs, order)[0])


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a periodic tail in the texts whose crc32(id) ends in 0:
    of n words, those from a = g % n on repeat the first p = 1 + (n - a) / (3 +
    g % 8) of them, g = crc32 / 10.  Other texts, and those of null ids, stay."""
    key, text = F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col)
    h = F.crc32(key.cast("string").cast("binary"))
    d = docs.select(key.alias("id"), text.alias("t"), h.alias("h"),
                    F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    d = d.select("id", "t", "w", F.floor(F.col("h") / 10).cast("long").alias("g"), F.size("w").cast("long").alias("n"))
    d = d.select("id", "t", "w", "n", "g", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    d = d.select("id", "t", "w", "n", "a", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long").alias("p"))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
                        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return d.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), F.array_join(place, " ")).otherwise(F.col("t")).alias(text_col))
