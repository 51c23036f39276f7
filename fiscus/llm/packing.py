"""Packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: pieces arrive in hash order, each task keeps a
fixed number of open sequences in a bitset keyed by free space, puts a piece
into the fullest one that holds it, and when it must open one too many closes
the fullest first.  A task packs about ``pieces_per_task`` pieces, so no
sequence, and no state, spans tasks.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import ship, text_or_empty, written

PIECES = "id long, piece int, start long, length long, ids_crc32 long, ids binary"
_LOADED: dict = {}


class PieceEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The ids are those of the tokenizer file; every distinct run between single
    spaces is encoded once per worker and kept in a bounded table.  A blank
    never joins what stands on its two sides, except inside a run of white
    space: texts with such runs are split by the tokenizer's own pattern.
    """

    def __init__(self, tokenizer_json: str, pattern: str, keep: int = 500_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel  # noqa: F401 -- the file's own pre-tokenizer

        whole = Tokenizer.from_file(tokenizer_json)
        self.model = whole.model
        self.added = {t.content: struct.pack("<I", i) for i, t in whole.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.find = regex.compile(pattern).findall
        self.two_blanks = re.compile(r"\s\s").search
        self.keep, self.pieces, self.runs = keep, {}, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.to_model = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _ids(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.to_model)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = self._ids(piece)
            self._store(self.pieces, piece, out)
        return out

    def _split(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.find(text)])

    def _run(self, run: str) -> bytes:
        """Ids of a blank and the run behind it.  A run of Latin letters is one
        match of the pattern, a mark behind it another."""
        if run and run[-1] in ".,;:!?" and run[:-1].isalpha() and max(run) < "\u0250":
            head = run[:-1]
            out = (self.runs.get(head) or self._run(head)) + self._piece(run[-1])
        elif run.isalpha() and max(run) < "\u0250":
            out = self._ids(" " + run)
        else:
            out = self._split(" " + run)
        self._store(self.runs, run, out)
        return out

    def _store(self, table: dict, key: str, ids: bytes) -> None:
        if len(table) >= self.keep:
            table.clear()
        if len(key) < 100:
            table[key] = ids

    def encode(self, text: str) -> bytes:
        """Ids of a text; a string of an added token of the file is that token."""
        if not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join([self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(self.split(text))])

    def _plain(self, text: str) -> bytes:
        if self.two_blanks(text):
            return self._split(text)
        first, *runs = text.split(" ")
        get = self.runs.get
        found = [get(r) for r in runs]
        if None in found:
            found = [self._run(r) if f is None else f for r, f in zip(runs, found)]
        return self._split(first) + b"".join(found)


def _encoder(path: str, pattern: str) -> PieceEncoder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = PieceEncoder(path, pattern)
    return _LOADED[path, pattern]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    if n <= most:
        return [(0, n)]
    head = n % most or most
    return [(0, head)] + [(s, most) for s in range(head, n, most)]


def tokenise(docs: DataFrame, tokenizer_json: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
             sequence_length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, ids) of every document:
    its ids, then ``end_id``.  Null text: empty, so one piece of one id.
    ``ids`` (packed 32-bit) is null unless asked for.  Text that spells an
    added token of the file gets its id, as the library called plainly does."""
    ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = _encoder(tokenizer_json, pattern).encode
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for i, (s, n) in enumerate(cut(len(ids) // 4, sequence_length)):
                    b = ids[4 * s:4 * (s + n)]
                    rows.append((key, i, s, n, zlib.crc32(b), b if with_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["id", "piece", "start", "length", "ids_crc32", "ids"])

    return d.mapInArrow(run, PIECES)


class BestFit:
    """Open bins by free space: ``bits`` has bit f set while some bin has f free."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open, self.bits, self.open, self.made = size, most_open, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of ``length``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b, self.made = self.size, self.made, self.made + 1
            if self.open >= self.most_open and length < self.size:
                self._take((self.bits & -self.bits).bit_length() - 1)
        rest = free - length
        if rest:
            self.bins[rest].append(b)
            self.bits |= 1 << rest
            self.open += 1
        return b, self.size - free


def pack(pieces: DataFrame, sequence_length: int = 2048, open_bins: int = 1024,
         pieces_per_task: int = 200_000) -> DataFrame:
    """``pieces`` with sequence_id and offset.  Lengths are 1..sequence_length.
    Pieces arrive by a hash of (id, piece); repeated rows are packed each."""
    ship(pieces.sparkSession)
    n = pieces.count()
    tasks = max(1, -(-n // pieces_per_task))
    order = F.xxhash64("id", "piece", "ids_crc32")
    p = pieces.withColumn("o", order).repartition(tasks, "o").sortWithinPartitions("o", "id", "piece")
    schema = pieces.select("id", "piece", "start", "length", "ids_crc32").schema.simpleString()[7:-1].replace(":", " ")
    keep = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        fit, base = BestFit(sequence_length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [fit.put(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                [*keep, "sequence_id", "offset"])

    return p.select(*keep).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer_json: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  sequence_length: int = 2048, open_bins: int = 1024) -> DataFrame:
    """Tokenise, cut and pack: one row per piece (id, piece, start, length,
    ids_crc32, sequence_id, offset).  Null and empty texts make one piece of
    the end id; an empty table makes no sequence; extra columns are ignored;
    null ids are packed like others.  Tokenising runs once, into scratch."""
    pieces = tokenise(docs, tokenizer_json, pattern, id_col, text_col, sequence_length).drop("ids")
    out = pack(written(pieces, "pieces"), sequence_length, open_bins)
    return out.withColumnRenamed("id", id_col)
