"""Repeated word windows by seed and extend.

Seeds are winnowed anchors: of the k-word hashes inside a window the smallest
is its anchor, so two equal windows have the same anchor at the same place.
Anchors that occur once are dropped by a join through a fixed-size bit filter
(which only ever lets too much through).  Each remaining anchor occurrence is
extended both ways to all windows that it is the anchor of; windows meet by
(anchor, window), added up in the tasks first, so a passage in a third of all
texts travels once per task.  Windows found twice or more go into a second bit
filter, against which each text is marked where it is read.  The filter errs
only for windows that occur once: those it lets through are known from the
counts, a third filter finds the texts that may hold one, and there the
windows in doubt are joined with the counted ones.  Marked windows that touch
make a maximal repeat.  There is one way for all anchors, however crowded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import Words, bit_filter, in_bits, keyed, mix64, ship, span_hash, text_blocks, written

FILTER_BITS = 1 << 27
#: The filters of windows take 16 bits a window, two of them set, up to this size (32 MB).
MOST_BITS = 1 << 28
RESULT = "id long, n_words long, n_removed long, kept_text string, repeats array<struct<start:long,end:long>>"
#: A text is settled (results, no t), or in doubt (t, starts of its sure windows, and (anchor, window, start) of the others).
SETTLED = RESULT + ", k1 long, k2 long, t string, sure binary, doubt binary"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "repeats": _RUNS,
          "k1": pa.int64(), "k2": pa.int64(), "t": pa.string(), "sure": pa.binary(), "doubt": pa.binary()}


class Windows:
    """Windows of ``size`` words in a block of texts: start (word index), doc,
    and anchor, the first word of the smallest ``seed``-word hash inside."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, seed: int):
        w = Words(data, offsets)
        self.first, self.word = w.first, w.hashes()
        n = np.maximum(np.diff(w.first) - size + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.first[:-1], n)
        if not len(self.start):
            self.gram = self.anchor = np.zeros(0, np.int64)
            return
        at = np.arange(len(self.word) - seed + 1)
        self.gram = span_hash(self.word, at, at + seed)
        view = np.lib.stride_tricks.sliding_window_view(self.gram, size - seed + 1)
        self.anchor = self.start + view[self.start].argmin(1)

    def prints(self, size: int, which: np.ndarray) -> np.ndarray:
        s = self.start[which]
        return span_hash(self.word, s, s + size, 0x51)


def seed_counts(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """(h, n): anchors and how often they occur, added up per block first."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0)):
                w = Windows(data, offsets, size, seed)
                h, n = np.unique(w.gram[np.unique(w.anchor)], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("t").mapInArrow(run, "h long, n long")


def _added(h: np.ndarray, fp: np.ndarray, n: np.ndarray):
    """Equal (h, fp) as one, with the sum of n."""
    order = np.lexsort((h, fp))
    h, fp, n = h[order], fp[order], n[order]
    new = np.append(True, (fp[1:] != fp[:-1]) | (h[1:] != h[:-1]))[:len(h)]
    at = np.flatnonzero(new)
    return h[at], fp[at], np.add.reduceat(n, at) if len(at) else n


def window_counts(docs: DataFrame, bits, size: int, seed: int, at_once: int = 1 << 20) -> DataFrame:
    """(h, fp, n): anchor and fingerprint of the windows of shared anchors, and
    how often they occur, added up over a task as far as ``at_once`` of them go."""

    def rows(h, fp, n):
        for i in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)].view(np.int64)) for x in (h, fp, n)], ["h", "fp", "n"])

    def run(batches):
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kept, held, size_held = none, [], 0
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0)):
                w = Windows(data, offsets, size, seed)
                if not len(w.start):
                    continue
                hit = np.flatnonzero(in_bits(bits.value, w.gram[w.anchor]))
                held.append(_added(w.gram[w.anchor[hit]], w.prints(size, hit), np.ones(len(hit), np.int64)))
                size_held += len(held[-1][0])
                if size_held >= at_once:
                    kept, held, size_held = _added(*(np.concatenate(x) for x in zip(kept, *held))), [], 0
                    if len(kept[0]) >= at_once:
                        yield from rows(*kept)
                        kept = none
        yield from rows(*_added(*(np.concatenate(x) for x in zip(kept, *held))))

    return docs.select("t").mapInArrow(run, "h long, fp long, n long")


def window_filter(windows: DataFrame, most_bits: int) -> np.ndarray:
    """A bit filter of a written table of windows (fp), two bits each, sized by their number up to ``most_bits``."""
    bits = min(most_bits, 1 << max(15, (16 * windows.count() - 1).bit_length()))
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    return bit_filter(windows.select(F.explode(F.array("fp", turned)).alias("b")), bits)


def in_filter(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which windows a ``window_filter`` may hold."""
    u = fp.view(np.uint64)
    return in_bits(bits, u) & in_bits(bits, (u << np.uint64(32)) | (u >> np.uint64(32)))


def let_through(windows: DataFrame, bits) -> DataFrame:
    """The rows (fp) that a window filter lets through."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return windows.select("fp").mapInArrow(run, "fp long")


def without(words: list, starts, size: int) -> tuple:
    """(n_words, n_removed, kept text, repeats) of a text whose windows at the sorted ``starts`` are repeated."""
    runs: list = []
    for s in starts:
        if runs and s <= runs[-1][1]:
            runs[-1][1] = s + size
        else:
            runs.append([s, s + size])
    kept, at = [], 0
    for a, b in runs:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in runs]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[c]) for i, c in enumerate(names)], names)


def settle(docs: DataFrame, bits, twice, doubt, size: int, seed: int) -> DataFrame:
    """SETTLED rows: every text marked by the filter ``twice``; a window that
    may be one of ``doubt`` is in doubt unless it comes again in its block."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(0)):
                w, n = Windows(data, offsets, size, seed), len(offsets) - 1
                hit = np.flatnonzero(in_bits(bits.value, w.gram[w.anchor])) if len(w.start) else np.zeros(0, np.int64)
                fp = w.prints(size, hit) if len(hit) else np.zeros(0, np.uint64)
                some = in_filter(twice.value, fp)
                hit, fp = hit[some], fp[some]
                h, of = (w.gram[w.anchor[hit]], w.doc[hit]) if len(hit) else (fp, hit)
                start = (w.start[hit] - w.first[of]) if len(hit) else hit
                _, group, times = np.unique(fp ^ mix64(h), return_inverse=True, return_counts=True)
                unsure = in_filter(doubt.value, fp) & (times[group] == 1)
                edge = np.searchsorted(of, np.arange(n + 1))
                raw, out = data.tobytes(), []
                for i, key in enumerate(zip(*(batch.column(c).slice(row, n).to_pylist() for c in (1, 2, 3)))):
                    part, text = slice(edge[i], edge[i + 1]), raw[offsets[i]:offsets[i + 1]]
                    maybe = unsure[part]
                    if maybe.any():
                        three = np.stack([x[part][maybe].view(np.int64) for x in (h, fp, start)])
                        out.append((key[0], None, None, None, None, *key[1:], text.decode(), start[part][~maybe].tobytes(), three.tobytes()))
                    else:
                        out.append((key[0], *without(text.split(), start[part].tolist(), size), None, None, None, None, None))
                yield _batch(out, list(_KINDS))

    return docs.select("t", "id", "k1", "k2").mapInArrow(run, SETTLED)


def in_doubt(texts: DataFrame) -> DataFrame:
    """(h, fp, k1, k2, s): the windows in doubt of SETTLED rows, those of equal rows once."""

    def run(batches):
        for batch in batches:
            for k1, k2, packed in zip(*(c.to_pylist() for c in batch.columns)):
                h, fp, s = np.frombuffer(packed, np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, fp, np.full(len(s), k1), np.full(len(s), k2), s)],
                                                 ["h", "fp", "k1", "k2", "s"])

    return texts.select("k1", "k2", "doubt").dropDuplicates(["k1", "k2"]).mapInArrow(run, "h long, fp long, k1 long, k2 long, s long")


def repeats(docs: DataFrame, size: int = 35, seed: int = 10, id_col: str = "doc_id", text_col: str = "text",
            filter_bits: int = FILTER_BITS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text (kept
    words joined by one space), repeats (maximal runs of words, start and end,
    that windows of ``size`` words which also start elsewhere cover).

    Words are runs without U+0020, U+0009-U+000D, compared unchanged.  Null
    and empty texts have no words; texts under ``size`` words keep all; rows
    that repeat a text are each other's elsewhere; null ids are allowed; extra
    columns are ignored.  Windows are compared by two 64-bit hashes (anchor
    and window).  The filters (bits, powers of two) have a greatest size; a
    full one leaves more windows in doubt and changes no result.
    """
    if not 0 < seed <= size:
        raise ValueError("the seed must not be longer than the window")
    spark = docs.sparkSession
    ship(spark)
    d = keyed(docs, id_col, text_col)
    shared = seed_counts(d, size, seed).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    bits = spark.sparkContext.broadcast(bit_filter(shared, filter_bits))
    counts = written(window_counts(d, bits, size, seed).groupBy("h", "fp").agg((F.sum("n") > 1).alias("many")), "windows")
    again = counts.where("many").select("h", "fp")
    twice = spark.sparkContext.broadcast(window_filter(again, most_bits))
    once = written(let_through(counts.where("NOT many"), twice), "windows-in-doubt")
    doubt = spark.sparkContext.broadcast(window_filter(once, most_bits))
    settled = written(settle(d, bits, twice, doubt, size, seed), "settled")
    texts = settled.where("t IS NOT NULL")
    sure = in_doubt(texts).join(again, ["h", "fp"]).groupBy("k1", "k2").agg(F.collect_list("s").alias("s"))
    both = texts.join(sure, ["k1", "k2"], "left").select("id", "t", "sure", "s")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches):
        for batch in batches:
            yield _batch([(key, *without(text.encode().split(), sorted(np.frombuffer(sure, np.int64).tolist() + (more or [])), size))
                          for key, text, sure, more in zip(*(c.to_pylist() for c in batch.columns))], names)

    return settled.where("t IS NULL").select(*names).unionByName(both.mapInArrow(run, RESULT)).withColumnRenamed("id", id_col)
