"""Quality classifier: regularised quadratic discriminant analysis.

Documents become a vector of transformed statistics; each class gets a mean
and a covariance shrunk towards a multiple of the identity; a score is the
difference of the classes' Mahalanobis log densities, from Cholesky factors
computed once.  Training adds up class moments in the tasks (a few hundred
numbers each), so it covers every labelled row at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import SPACE, Words, ship, text_blocks, text_or_empty

FEATURES = ("log_words", "log_chars", "mean_word", "sd_word", "upper", "digits", "symbols", "punctuation",
            "distinct_words", "top_word", "distinct_lines", "words_per_line", "exclaimed", "short_words")
_UP, _LOW, _DIGIT, _SYMBOL, _PUNCT, _BANG = (np.zeros(256, bool) for _ in range(6))
_UP[65:91] = True
_LOW[97:123] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>~^_=+{}[]\\/@"]] = True
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True
_BANG[ord("!")] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; ratios go through arcsine of the square
    root, counts through log(1 + x).  An empty text gives ratios of zero words."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    h = w.hashes()
    doc = np.repeat(np.arange(n), np.diff(w.first))
    words = np.diff(w.first).astype(float)

    def bytes_in(table):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    chars, blanks = bytes_in(_HEAD), bytes_in(SPACE)
    solid = np.maximum(chars - blanks, 1)
    letters = np.maximum(bytes_in(_UP) + bytes_in(_LOW), 1)
    heads = np.concatenate([[0], np.cumsum(_HEAD[data])])
    length = (heads[w.end] - heads[w.start]).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(doc, length, n) / some
    var = np.maximum(np.bincount(doc, length ** 2, n) / some - mean ** 2, 0)
    short = np.bincount(doc, length <= 3, n) / some
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(d)))
    distinct = np.bincount(d[at], minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, d[at], counts)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks, breaks + 1])) if len(data) else offsets[:1]
    lines, line_doc, line_hash = np.ones(n), np.zeros(0, int), np.zeros(0, np.uint64)
    if len(h):
        line = np.searchsorted(edges, w.start, side="right")
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        line_doc = doc[first]
        sums = np.add.reduceat(h * (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h)))) + 1).astype(np.uint64), first)
        line_hash = sums
        lines = np.maximum(np.bincount(line_doc, minlength=n), 1).astype(float)
    pair = np.unique(np.stack([line_doc.astype(np.uint64), line_hash], 1), axis=0) if len(line_doc) else np.zeros((0, 2))
    distinct_lines = np.bincount(pair[:, 0].astype(int), minlength=n) / lines

    def share(x, of):
        return np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))

    return np.stack([
        np.log1p(words), np.log1p(chars), np.log1p(mean), np.log1p(np.sqrt(var)), share(bytes_in(_UP), letters),
        share(bytes_in(_DIGIT), solid), share(bytes_in(_SYMBOL), solid), share(bytes_in(_PUNCT), solid),
        np.arcsin(np.sqrt(np.clip(distinct, 0, 1))), share(top, some), np.arcsin(np.sqrt(np.clip(distinct_lines, 0, 1))),
        np.log1p(words / lines), share(bytes_in(_BANG), solid), np.arcsin(np.sqrt(np.clip(short, 0, 1)))], 1)


@dataclass(frozen=True)
class Discriminant:
    """Two classes: log prior, mean, inverse Cholesky factor and log determinant."""

    log_prior: np.ndarray
    mean: np.ndarray
    inverse_factor: np.ndarray
    log_det: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    soften: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = [self.log_prior[k] - 0.5 * (np.sum(((z - self.mean[k]) @ self.inverse_factor[k].T) ** 2, 1) + self.log_det[k])
                   for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(-(density[1] - density[0]) / self.soften, -700, 700)))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row; null text is empty, null ids pass
    through, extra columns are ignored.  Texts are read once, where they are."""
    ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(1)):
                x = features(data, offsets)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), rows], ["id", "x"])

    return d.mapInArrow(run, "id long, x array<double>")


def _matrix(rows: pa.Array) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(FEATURES))


def _moments(rows: DataFrame) -> DataFrame:
    """(label, n, s, ss) per task and class from (label, x)."""

    def run(batches):
        d = len(FEATURES)
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for k in (0, 1):
                part = x[y == k]
                n[k] += len(part)
                s[k] += part.sum(0)
                ss[k] += part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(n, pa.float64()), pa.array(list(s), pa.list_(pa.float64())),
             pa.array([m.ravel() for m in ss], pa.list_(pa.float64()))], ["label", "n", "s", "ss"])

    return rows.mapInArrow(run, "label int, n double, s array<double>, ss array<double>")


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        shrink: float = 0.1, soften: float = 4.0) -> Discriminant:
    """Class moments over every labelled row of ``describe`` (labels 0 and 1; others and
    null labels or ids are left out).  The tasks' moments, one row each, are
    added by position in Spark; two rows reach the driver.  With fewer than two
    rows of a class its moments are those of the other (scores then say little,
    but are defined)."""
    y = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    y = y.where("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    parts = _moments(described.join(y, "id").select("label", "x"))
    width = len(FEATURES)
    flat = parts.select("label", F.posexplode(F.concat(F.array("n"), "s", "ss")).alias("i", "v"))
    sums = flat.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + width + width * width))
    for label, i, v in sums:
        total[label, i] = v
    n, s, ss = total[:, 0], total[:, 1:1 + width], total[:, 1 + width:].reshape(2, width, width)
    both = max(n.sum(), 1)
    center = s.sum(0) / both
    scale = np.sqrt(np.maximum(np.diagonal(ss.sum(0)) / both - center ** 2, 1e-6))
    mean, factor, log_det = np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2)
    for k in (0, 1):
        j = k if n[k] >= 2 else 1 - k
        m = max(n[j], 1)
        raw = s[j] / m
        cov = (ss[j] / m - np.outer(raw, raw)) / np.outer(scale, scale)
        mean[k] = (raw - center) / scale
        cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / width, 1e-2) * np.eye(width)
        lower = np.linalg.cholesky(cov)
        factor[k] = np.linalg.inv(lower)
        log_det[k] = 2 * np.log(np.diag(lower)).sum()
    prior = np.log((n + 1) / (n + 1).sum())
    return Discriminant(prior, mean, factor, log_det, center, scale, soften)


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) for every row of ``describe``; equal texts score alike."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["id", "score"])

    return described.mapInArrow(run, "id long, score double")
