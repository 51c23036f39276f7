"""Helpers shared by the operators: scratch tables, row keys, vectorised words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SEP = r"[\x20\x09-\x0D]+"


# ---------------------------------------------------------------- scratch
def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a folder of its own; on
    a cluster a missing setting is an error, as executors do not share /tmp.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fiscus-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: the
    lineage ends here, the rows are computed once, and the planner knows
    their size (so a later join broadcasts them only below Spark's own bound)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str):
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, k1, k2): the id as given, the text (null: empty) and a non-null
    key of the row, (id, hash of text), that survives recomputation.  Rows
    that repeat id and text share a key; null ids are allowed.  Other columns
    are dropped here, so their names cannot clash."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("t"),
    ).select("id", "t", F.coalesce("id", F.lit(-(2**63))).alias("k1"), F.xxhash64("t").alias("k2"))


def bit_filter(values, bits: int) -> np.ndarray:
    """A set of 64-bit hashes as a bit array of ``bits`` bits (a power of two):
    (hash mod bits) is set for each value.  ``values`` is a one-column frame.
    Only ``bits / 8`` bytes reach the driver, however many values there are."""
    n = F.pmod(F.col(values.columns[0]), F.lit(bits)).cast("long")
    # dealt by bucket first: 8 bytes a value move, not a 4 KB bitmap per task and bucket
    rows = (values.select(n.alias("n")).withColumn("b", F.bitmap_bucket_number("n")).repartition("b")
            .groupBy("b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m")))
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for b, m in rows.collect():
        at = (b - 1) * 4096 if b > 0 else 0
        out[at:at + 4096] |= np.frombuffer(bytes(m), np.uint8)
    return out


PACKED = "bucket int, packed binary"
_BUCKETS, _MORE = 10, 9


def packed_hashes(blocks, bits: int, at_once: int = 1 << 20):
    """Batches of PACKED for ``repeat_filter``: the hashes of ``blocks`` (arrays of
    64-bit hashes), ``at_once`` and more together, by their place in a filter of
    ``bits`` bits and 9 bits more, which tell most hashes of one place apart.
    A bucket's sorted keys are stored as differences, under 3 bytes a hash."""
    places = bits.bit_length() - 1
    width = places - _BUCKETS + _MORE

    def packed(held):
        h = np.concatenate(held)
        bucket, bit = _bitmap_place(h & np.uint64(bits - 1))
        key = np.sort(((bucket << np.uint64(15)) | bit) << np.uint64(_MORE) | (h >> np.uint64(places)) & np.uint64((1 << _MORE) - 1))
        key = key[np.concatenate([np.ones(min(len(key), 2), bool), key[2:] != key[:-2]])]  # often is twice
        cuts = np.searchsorted(key, np.arange((1 << _BUCKETS) + 1, dtype=np.uint64) << np.uint64(width))
        full = np.flatnonzero(np.diff(cuts))
        rows = []
        for a, b in zip(cuts[full], cuts[full + 1]):
            step = np.diff(key[a:b] & np.uint64((1 << width) - 1), prepend=np.uint64(0)).astype("<u4")
            high = np.ascontiguousarray((step >> np.uint32(16)).astype("<u2").view(np.uint8).reshape(-1, 2).T)
            rows.append(len(step).to_bytes(4, "little") + step.astype("<u2").tobytes() + pa.Codec("zstd").compress(high.tobytes(), asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "packed"])

    held, size = [], 0
    for h in blocks:
        if len(h):
            held.append(h.view(np.uint64))
            size += len(h)
        if size >= at_once:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def repeat_filter(packed: DataFrame, bits: int) -> np.ndarray:
    """A bit array for ``in_bits``, of ``bits`` bits, of the hashes that occur twice
    or more in all rows of ``packed`` (see ``packed_hashes``); false positives only.
    Tasks hold a fixed table each, and ``bits / 8`` bytes reach the driver."""
    width, step = bits.bit_length() - 1 - _BUCKETS + _MORE, bits >> _BUCKETS

    def run(batches):
        seen, twice, now = np.zeros(1 << (width - 3), np.uint8), np.zeros(step, bool), None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for bucket, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    if now is not None:
                        yield out()
                    now = bucket
                    seen[:], twice[:] = 0, False
                row = row.as_py()
                n = int.from_bytes(row[:4], "little")
                high = np.frombuffer(pa.Codec("zstd").decompress(row[4 + 2 * n:], 2 * n, asbytes=True), np.uint8).reshape(2, -1)
                key = np.cumsum(np.frombuffer(row, "<u2", n, 4) + (np.ascontiguousarray(high.T).view("<u2").ravel().astype(np.int64) << 16))
                again = np.concatenate([[False], key[1:] == key[:-1]])
                one = key[~again]
                at, bit = one >> 3, np.left_shift(1, one & 7).astype(np.uint8)
                twice[key[again] >> _MORE] = True
                twice[one[seen[at] & bit > 0] >> _MORE] = True
                np.bitwise_or.at(seen, at, bit)
        if now is not None:
            yield out()

    out, size = np.zeros(bits // 8 + 4096, np.uint8), step // 8
    for bucket, m in packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED).collect():
        out[bucket * size:(bucket + 1) * size] = np.frombuffer(bytes(m), np.uint8)
    return out


def maybe_in(df: DataFrame, key, values: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``df`` with ``maybe``: whether the 64-bit hash ``key`` of a row may be in the
    one-column frame ``values`` (false positives only).  The filter is a row per 64
    bits that are not all unset: tasks get at most ``bits / 64`` small rows, however
    many values there are, and only rows that may match need to be moved."""
    n = F.pmod(F.col(values.columns[0]), F.lit(bits))
    masks = (values.select(F.shiftright(n, 6).alias("_word"), n.bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
             .groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask")))
    rows = df.withColumn("_n", F.pmod(key, F.lit(bits))).withColumn("_word", F.shiftright("_n", 6))
    set_bit = F.expr("shiftright(_mask, CAST(_n & 63 AS INT)) & 1L") == 1
    return rows.join(F.broadcast(masks), "_word", "left").withColumn("maybe", F.coalesce(set_bit, F.lit(False))).drop("_word", "_n", "_mask")


def in_bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (int64 or uint64) may be in the set; false positives only.
    Bit n of the SQL bitmaps is bit (n - 1) of the bytes for n >= 1, bit 0 for n = 0."""
    bits = np.uint64((len(bitmap) - 4096) * 8)
    n = h.astype(np.uint64) & (bits - np.uint64(1))
    bucket, pos = _bitmap_place(n)
    at = bucket * np.uint64(4096) + (pos >> np.uint64(3))
    return (bitmap[at.astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap_place(n: np.ndarray):
    """(bucket from 0, bit in bucket) as bitmap_bucket_number / bitmap_bit_position
    place a non-negative n: bucket 1 + (n - 1) div 32768, bit (n - 1) mod 32768; 0 alone in bucket 0, bit 0."""
    m = np.where(n > 0, n - np.uint64(1), np.uint64(0))
    return m >> np.uint64(15), m & np.uint64(32767)


# ---------------------------------------------------------------- hashing
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_POW[0]) < n:
        size = max(n, 1 << 20)
        for i, r in enumerate((_R, _RINV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POW[i] = np.cumprod(p)
    return _POW[0][:n], _POW[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each run values[start:end] (uint64), from one prefix sum."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))


class Words:
    """The words (runs without U+0020, U+0009-U+000D) of a block of texts.

    data: the UTF-8 bytes of all texts; start, end: byte range of each word;
    first: index of each text's first word, one entry more than texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        table = _BYTE_LOW if lower else _BYTE
        return span_hash(table[self.data], self.start, self.end)


def text_blocks(texts: pa.Array, block_bytes: int = 1 << 19):
    """(first row, bytes, offsets) of consecutive rows of at most ``block_bytes``
    each, or one row if it is longer.  Null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + block_bytes, side="right")) - 1)
        to = min(to, n)
        yield at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


# ---------------------------------------------------------------- shipping
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this subpackage, once per application, so tasks import it
    wherever the session was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="fiscus-ship-"), "fiscus_llm.zip")
    with zipfile.ZipFile(name, "w") as z:
        z.write(os.path.join(os.path.dirname(here), "__init__.py"), "fiscus/__init__.py")
        for f in sorted(os.listdir(here)):
            if f.endswith(".py"):
                z.write(os.path.join(here, f), f"fiscus/llm/{f}")
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)
