"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens; every block of texts lists its distinct words
once and keeps each text as the positions of its words in that list.  The
lists are dealt by word hash into buckets, where each distinct word is encoded
once; the ids go back to the blocks, which put them in place by position.
What moves is each block's distinct words and their ids: a hot word travels
once per block, not once per occurrence, and the positions stay where they
are, in a table bucketed by block.  Decoding joins the token-byte table, whose
size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.llm.common import scratch_path, ship, text_or_empty

# kind 0: one bucket of a block's words, in payload; kind 1: some of its texts
PARTS = "block long, kind int, bucket int, slots binary, payload binary, doc_ids array<long>"
_FIELDS = [("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("slots", pa.binary()),
           ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
_ENCODERS: dict = {}


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token bytes, rank) of a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary as a table (id, bytes)."""
    return spark.createDataFrame([(r, bytearray(t)) for t, r in read_ranks(path)], "id int, bytes binary")


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", 9).compress(raw, asbytes=True)


def _unpressed(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as byte planes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _pressed(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpressed(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack(words: list[bytes]) -> bytes:
    """Byte strings: their number, sizes and bytes, compressed."""
    sizes = np.array([len(w) for w in words], "<u4").tobytes()
    return _pressed(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    """Sizes and joined bytes of a packed list."""
    raw = _unpressed(data)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4), raw[4 + 4 * n:]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])


def _pieces(sizes: np.ndarray, words_at_once: int = 1 << 19):
    """(first, last, start, end): texts first..last of ``words_at_once`` words (a
    longer text alone), which are the words start..end of them all."""
    ends, first = np.cumsum(sizes.astype(np.int64)), 0
    while first < len(sizes):
        start = int(ends[first]) - int(sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, start + words_at_once, side="right")))
        yield first, last, start, int(ends[last - 1])
        first = last


class Block:
    """Texts with their distinct words, numbered as they come."""

    def __init__(self):
        self.slot, self.at, self.ids, self.sizes, self.bytes = {}, array("I"), [], [], 0

    def add(self, key, words: list[str], size: int) -> None:
        slot = self.slot
        for w in words:
            if w not in slot:
                slot[w] = len(slot)
        self.at.extend([slot[w] for w in words])
        self.ids.append(key)
        self.sizes.append(len(words))
        self.bytes += size

    def parts(self, block: int, buckets: int):
        """The rows of the block; words are numbered anew, most frequent first,
        so that positions compress well."""
        flat = np.frombuffer(self.at, np.uint32) if len(self.at) else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(self.slot)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        names = [w.encode() for w in self.slot]
        names = [names[i] for i in order]
        deal = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int64, len(names))
        place = np.argsort(deal, kind="stable")
        for part in np.split(place, np.flatnonzero(np.diff(deal[place])) + 1):
            if len(part):
                yield _rows([(block, 0, int(deal[part[0]]), _squeeze(np.diff(part, prepend=0)), _pack([names[i] for i in part]), None)])
        sizes = np.array(self.sizes, "<u4")
        for first, last, a, b in _pieces(sizes):
            yield _rows([(block, 1, None, sizes[first:last].tobytes(), _squeeze(rank[flat[a:b]]), self.ids[first:last])])


def split_blocks(docs: DataFrame, pattern: str, buckets: int, id_col: str, text_col: str,
                 block_bytes: int = 16 << 20) -> DataFrame:
    """PARTS of every block: its distinct words by bucket, its texts as positions."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("t"))

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        number, block = TaskContext.get().partitionId() << 24, Block()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                block.add(key.as_py(), find(text), len(text))
                if block.bytes >= block_bytes:
                    yield from block.parts(number, buckets)
                    number, block = number + 1, Block()
        yield from block.parts(number, buckets)

    return d.mapInArrow(run, PARTS)


def bucketed(parts: DataFrame, name: str) -> DataFrame:
    """``parts`` written to scratch as a table bucketed by block."""
    spark = parts.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (parts.write.bucketBy(n, "block").option("path", scratch_path(spark, name)).option("compression", "uncompressed")
     .format("parquet").saveAsTable(table))
    return spark.table(table)


def _encoder(ranks: list, pattern: str):
    import tiktoken

    key = (hashlib.sha256(b"".join(t + b" %d\n" % r for t, r in ranks)).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
    return _ENCODERS[key]


def encode_words(parts: DataFrame, ranks, pattern: str, tokens: DataFrame | None = None) -> DataFrame:
    """(block, slots, ids): the encoded word lists of each block, slots and packed
    ids; with ``tokens`` (id, bytes), also rows (block, id, bytes) of the ids that
    occur in the block, joined with that table, some of them repeated.  All rows of a
    bucket meet, sorted, in one task, and each distinct word is encoded at its first
    row; a bucket holds its share of the vocabulary, and of every block's list.
    Blocks are dealt before the ids get a row each: those rows are not moved."""
    lists = parts.where("kind = 0").select("block", "bucket", "slots", "payload")
    lists = lists.repartition("bucket").sortWithinPartitions("bucket", "block")
    back = tokens is not None

    def run(batches):
        one = _encoder(ranks.value, pattern)._encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                sizes, raw = _unpack(r["payload"])
                ends = list(accumulate(sizes.tolist(), initial=0))
                out = []
                for a, b in zip(ends, ends[1:]):
                    w = raw[a:b]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(one(w), "<u4").tobytes()
                    out.append(ids)
                rows.append((r["block"], r["slots"], _pack(out), np.unique(np.frombuffer(b"".join(out), "<u4")).astype(np.int32) if back else None))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32())))],
                                             ["block", "slots", "ids", "used"])

    encoded = lists.mapInArrow(run, "block long, slots binary, ids binary, used array<int>")
    encoded = encoded.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    if not back:
        return encoded.drop("used")
    none, no_id = F.lit(None).cast("binary"), F.lit(None).cast("int")
    apart = encoded.select("block", F.explode(F.concat(
        F.array(F.struct("slots", "ids", no_id.alias("id"))),
        F.transform("used", lambda i: F.struct(none.alias("slots"), none.alias("ids"), i.alias("id"))))).alias("x")).select("block", "x.*")
    return apart.join(F.broadcast(tokens), "id", "left").select("block", "slots", "ids", "id", "bytes")


def _table(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and values of the ids of each word of a block."""
    number, parts = np.zeros(0, np.int64), []
    for slots, ids in lists:
        slots = np.cumsum(_unsqueeze(slots.as_py()).astype(np.int64))
        sizes, raw = _unpack(ids.as_py())
        parts.append((slots, sizes.astype(np.int64) // 4, np.frombuffer(raw, "<u4")))
    n = sum(len(p[0]) for p in parts)
    number, start, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for slots, sizes, ids in parts:
        number[slots], start[slots] = sizes, at + np.cumsum(sizes) - sizes
        at += len(ids)
    return start, number, np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, "<u4")


def _bytes_of(ids, tokens: dict) -> bytes | None:
    """The joined bytes of packed ids, an Arrow scalar."""
    x = ids.as_py()
    return None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist()))


def put_in_place(parts: DataFrame, encoded: DataFrame) -> DataFrame:
    """(id, ids), and decoded if ``encoded`` has ``bytes``: the ids of every text, packed
    little-endian 32-bit.  The texts' positions are read bucket by bucket, without
    a shuffle; a block meets its lists in one call, in rows of bounded size."""
    texts = parts.where("kind = 1").select("block", F.col("slots").alias("sizes"), "payload", "doc_ids")
    back = "bytes" in encoded.columns
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())][:2 + back])

    def filled(slots, sizes, table):
        start, number, values = table
        n = number[slots]
        ends = np.cumsum(n)
        ids = values[np.repeat(start[slots] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4")
        cuts = 4 * np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(sizes)]])
        out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
        return out.cast(pa.binary())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.filter(right.column("slots").is_valid())
        table, look = _table(zip(lists.column("slots"), lists.column("ids"))), {}
        if back:
            known = right.filter(right.column("id").is_valid())
            look = dict(zip(known.column("id").to_pylist(), known.column("bytes").to_pylist()))
        rows = []
        for sizes, payload, keys in zip(*(left.column(c) for c in ("sizes", "payload", "doc_ids"))):
            out = filled(_unsqueeze(payload.as_py()), np.frombuffer(sizes.as_py(), "<u4").astype(np.int64), table)
            cols = [keys.values, out]
            if back:
                cols.append(pa.array([_bytes_of(x, look) for x in out], pa.binary()))
            rows.append(pa.RecordBatch.from_arrays(cols, schema=schema))
        return pa.Table.from_batches(rows, schema)

    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, "id long, ids binary" + ", decoded binary" * back)


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, buckets: int | None, tokens) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    n = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = bucketed(split_blocks(docs, pattern, n, id_col, text_col), "bpe_parts")
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    return put_in_place(parts, encode_words(parts, ranks, pattern, tokens)).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           buckets: int | None = None) -> DataFrame:
    """(id, ids binary) per row: the ids of the whole text by rank merges of
    each match of ``pattern``, without special tokens, packed little-endian.

    Null and empty texts have no ids; repeated rows and null ids keep a row
    each; extra columns are ignored; an empty table gives no rows.  ``buckets``
    is the number of word buckets (default: two per shuffle partition).  The
    split texts are written to scratch once, so ids of blocks never change.
    """
    return _encoded(docs, ranks_path, pattern, id_col, text_col, buckets, None)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               buckets: int | None = None) -> DataFrame:
    """(id, ids, decoded): ``encode``, and the bytes of the ids by the join that
    ``decode`` makes, over the blocks of the texts: the ids that occur in a
    block join the token-byte table on their way back to it, so nothing is
    written or moved a second time."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, buckets, token_table(docs.sparkSession, ranks_path))


def _in_blocks(encoded: DataFrame, ids_col: str, block_bytes: int) -> DataFrame:
    """(block, row, tokens): every row of ``encoded`` as a struct with its
    block, and for each block one more row that lists its distinct ids.  A
    block ends with the row that fills ``block_bytes`` of ids."""
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(f"`{ids_col}`").alias("ids"))
    row_type = T.StructType([T.StructField(f.name, f.dataType) for f in encoded.schema.fields])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", row_type),
                           T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def out(block, row, tokens):
        n = len(row)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), row, pa.array(tokens, pa.list_(pa.int32()))],
                                          ["block", "row", "tokens"])

    def run(batches):
        block, held, size, last = TaskContext.get().partitionId() << 24, [], 0, None

        def distinct():
            return out(block, pa.nulls(1, last), [np.unique(np.concatenate(held)).astype(np.int32)])

        for batch in batches:
            row, ids, first = batch.column(0), batch.column(1), 0
            last = row.type
            for i, x in enumerate(ids):
                x = x.as_py()
                if x:
                    held.append(np.unique(np.frombuffer(x, "<u4")))
                    size += len(x)
                if size >= block_bytes:
                    yield out(block, row.slice(first, i + 1 - first), [None] * (i + 1 - first))
                    yield distinct()
                    block, held, size, first = block + 1, [], 0, i + 1
            if first < len(row):
                yield out(block, row.slice(first), [None] * (len(row) - first))
        if held:
            yield distinct()

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", block_bytes: int = 16 << 20) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ids, by a join
    with the token-byte table.  Each block of rows joins its distinct ids,
    not every occurrence, with that table (as large as the vocabulary of the
    rank file, hence broadcast); the bytes go back to the block, whose rows stay
    in a table bucketed by block, and are put in place by position.

    Null ids decode to null, empty ones to nothing; an id outside the table is
    an error; other columns stay as they are."""
    spark = encoded.sparkSession
    ship(spark)
    blocks = bucketed(_in_blocks(encoded, ids_col, block_bytes), "bpe_rows")
    used = blocks.where("tokens is not null").select(F.col("block").alias("of"), F.explode("tokens").alias("id"))
    found = used.join(F.broadcast(token_table(spark, ranks_path)), "id", "left").select("of", "id", "bytes")
    rows, at = blocks.where("tokens is null").select("block", "row"), encoded.columns.index(ids_col)
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.BinaryType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.column("bytes").null_count:
            raise ValueError("an id is not in the token table")
        look = dict(zip(right.column("id").to_pylist(), right.column("bytes").to_pylist()))
        row = pa.concat_arrays(left.column("row").chunks)
        decoded = [_bytes_of(x, look) for x in row.field(at)]
        return pa.Table.from_arrays([row, pa.array(decoded, pa.binary())], ["row", "decoded"])

    joined = rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(run, schema)
    return joined.select("row.*", "decoded")
