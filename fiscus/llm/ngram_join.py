"""N-gram Jaccard join by prefix trees, and its components.

Texts become sets of n-gram hashes in one global order, rarest first (n-grams
that many texts share come last).  Two sets that reach the threshold share an
n-gram of their prefixes, so sets meet by shared prefix n-grams; a bitmap of
each set's parities bounds its distance to others from below, which leaves
blocks of likely partners.  Each block's sets are stored in a trie and joined
by walking it: sets that share a path share their partial overlaps, and a
subtree is left as soon as the rest of its sets is too short to reach the
threshold.  Exact copies meet before as one set.

No step forms all pairs of a group: a block gives one link per set that it
joins to others, and a walk is left out where its set could only link to sets
already joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import (PACKED, Words, bit_filter, in_bits, maybe_in, mix64, packed_hashes, repeat_filter, ship, span_hash, text_blocks,
                               text_or_empty, written)
from fiscus.llm.components import components

SETS = "id long, x long, n long, s1 long, s2 long, bitmap binary, prefix array<long>"
HOT_TABLE = 1 << 20
BUCKET_ROWS = 200_000
BLOCK_TOKENS = 2_000_000
ID_BITS = 1 << 24
SHARED_BITS = 1 << 27


@dataclass(frozen=True)
class Threshold:
    """Sets of a and b n-grams link when den * overlap >= num * union."""

    num: int = 90
    den: int = 100

    def linked(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def apart(self, a, b):
        """The largest symmetric difference of linked sets."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def least_overlap(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Length of the prefix of which a linked, different set shares one
        n-gram; 0 where no different set can link."""
        p = n + (-self.num * n) // self.den + 1
        return np.where(self.den * n >= self.num * (n + 1), p, 0)


class Sets:
    """Distinct n-gram hashes of each text of a block, by text: token, doc, offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        w = Words(data, offsets)
        h = w.hashes(lower=True)
        words = np.diff(w.first)
        grams = np.where(words >= n, words - n + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(len(words)), grams)
        start = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(w.first[:-1], grams)
        token = span_hash(h, start, start + np.minimum(words, n)[doc], 0x33) if len(doc) else np.zeros(0, np.uint64)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
        self.token, self.doc = token[new], doc[new]
        self.offsets = np.searchsorted(self.doc, np.arange(len(words) + 1))

    def sums(self) -> list[np.ndarray]:
        """The two 64-bit hashes of each set."""
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(self.token ^ np.uint64(x)))]) for x in (0x5A17, 0xC0FFEE)]
        return [(c[self.offsets[1:]] - c[self.offsets[:-1]]).view(np.int64) for c in sums]


def parity_bitmap(token: np.ndarray, least: int = 64) -> bytes:
    """Bit (token mod bits) is the parity of such tokens; about one bit a token."""
    bits = max(least, 1 << (len(token) - 1).bit_length())
    count = np.bincount((token & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def frequent_grams(texts: DataFrame, n: int, at_once: int = 4 << 20):
    """Broadcast (token, count) arrays, sorted by token, of the n-grams held by
    at least max(16, all / HOT_TABLE) texts: at most HOT_TABLE of them.  Runs
    of ``at_once`` n-grams leave out those with under 4 texts, so counts are
    lower bounds.  The order only decides how fast the join is, not its result."""

    def counted(held):
        flat = np.concatenate(held)
        token, count = np.unique(flat, return_counts=True)
        often = count >= 4
        token = np.concatenate([token[often].view(np.int64), [0]])
        count = np.concatenate([count[often], [len(flat)]])
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(count.astype(np.int64)),
                                           pa.array(np.arange(len(token)) == len(token) - 1)], ["token", "n", "all"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0)):
                held.append(Sets(data, offsets, n).token)
                size += len(held[-1])
                if size >= at_once:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    spark = texts.sparkSession
    counts = written(texts.mapInArrow(run, "token long, n long, all boolean")
                     .groupBy("all", "token").agg(F.sum("n").alias("n")).where("all or n >= 16"), "gram-counts")
    total = counts.where("all").agg(F.sum("n")).first()[0] or 0
    hot = counts.where(~F.col("all") & (F.col("n") >= max(16, total // HOT_TABLE))).select("token", "n").toArrow()
    token = hot.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return spark.sparkContext.broadcast((token[order], hot.column(1).to_numpy()[order]))


class Order:
    """The global order of n-grams, rarest first: those no filter knows, then
    those that ``shared`` (a bit filter) may hold, then the ``hot`` ones by
    their counts; ties by hash.  Any order gives the same links."""

    def __init__(self, hot, shared=None):
        self.hot, self.shared = hot, shared

    def prefixes(self, s: Sets, limit: Threshold):
        """(n-grams of all prefixes, their number for each text)."""
        token, times = self.hot.value
        rank = np.zeros(len(s.token), np.int64)
        if self.shared is not None:
            rank = in_bits(self.shared.value, s.token).astype(np.int64)
        if len(token):
            i = np.minimum(np.searchsorted(token, s.token), len(token) - 1)
            rank = np.where(token[i] == s.token, times[i], rank)
        ordered = s.token[np.lexsort((s.token, rank, s.doc))]
        p = limit.prefix(np.diff(s.offsets))
        return ordered[np.repeat(s.offsets[:-1] - np.concatenate([[0], np.cumsum(p)[:-1]]), p) + np.arange(p.sum())], p


def shared_grams(texts: DataFrame, n: int, limit: Threshold, order: Order):
    """Broadcast bit filter of the n-grams in the prefixes of two texts or more.
    Put behind the others they leave the prefixes, which then hold few n-grams
    that unrelated texts share."""

    def run(batches):
        yield from packed_hashes((order.prefixes(Sets(data, offsets, n), limit)[0]
                                  for batch in batches for _, data, offsets in text_blocks(batch.column(0))), SHARED_BITS)

    return texts.sparkSession.sparkContext.broadcast(repeat_filter(texts.mapInArrow(run, PACKED), SHARED_BITS))


def all_sets(rows: DataFrame, n: int, limit: Threshold, order: Order) -> DataFrame:
    """SETS of every text: size, 128-bit hash of the set, bitmap and prefix."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(1)):
                s = Sets(data, offsets, n)
                size = np.diff(s.offsets)
                grams, p = order.prefixes(s, limit)
                s1, s2 = s.sums()
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]).astype(np.int32)),
                                                  pa.array(grams.view(np.int64)))
                bitmaps = [parity_bitmap(s.token[a:b]) if m else None
                           for a, b, m in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), p.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(size)), batch.column(2).slice(at, len(size)), pa.array(size.astype(np.int64)),
                     pa.array(s1), pa.array(s2), pa.array(bitmaps, pa.binary()), prefix], [x.split()[0] for x in SETS.split(", ")])

    return rows.mapInArrow(run, SETS)


class Union:
    """Union-find over 0..n-1 with labels; the label of a set is its smallest index."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        """One set of all sets that hold any of ``members``."""
        found = np.unique(self.label[members])
        if len(found) > 1:
            self.label[np.isin(self.label, found)] = found[0]

    def links(self, ids: np.ndarray):
        """(id, smallest id) of every member that is joined to another."""
        order = np.lexsort((ids, self.label))
        lab = self.label[order]
        first = np.concatenate([[True], lab[1:] != lab[:-1]])
        head = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        other = ids[order] != head
        return ids[order][other], head[other]


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def close_sets(n: np.ndarray, bitmaps: list[bytes], limit: Threshold) -> Union:
    """Joins at least all sets (sorted by size) whose bitmaps allow a link.

    Canopies: around a pivot, sets within twice the largest distance are
    joined; those within one distance need no pivot of their own, since what
    is near them is within two of the pivot.  It ends when all that remain
    are joined.
    """
    m, done = len(n), Union(len(n))
    width = np.array([len(b) // 8 for b in bitmaps])
    tables = {}

    # sizes that meet at a pivot differ by (den / num) ** 4 at most
    span = 2 ** (1 + int(np.ceil(4 * np.log2(limit.den / limit.num))))

    def table(c):
        """(first set, rows) of the sets of width c to c * span, folded to c."""
        if c not in tables:
            a, rows = int(np.searchsorted(width, c)), []
            for k in np.unique(width[a:]):
                if k > c * span:
                    break
                i, j = np.searchsorted(width, (k, k + 1))
                rows.append(_fold(np.frombuffer(b"".join(bitmaps[i:j]), "<u8").reshape(j - i, -1), c))
            tables[c] = (a, np.concatenate(rows))
        return tables[c]

    left = np.ones(m, bool)
    for p in range(m):
        if not left[p]:
            continue
        left[p] = False
        # all that a set of 0.9 to 1 / 0.9 of the pivot's size can link to
        lo = int(np.searchsorted(n, n[p] * limit.num * limit.num / limit.den ** 2 - 1e-6))
        hi = int(np.searchsorted(n, n[p] * limit.den ** 2 / limit.num ** 2 + 1e-6, side="right"))
        near = lo + np.flatnonzero(left[lo:hi])
        if not len(near):
            continue
        c = int(width[min(lo, p)])
        a, rows = table(c)
        bound = limit.apart(int(n[hi - 1]), int(n[hi - 1]))
        far = np.bitwise_count(rows[near - a] ^ rows[p - a]).sum(1)
        done.join(np.append(near[far <= 2 * bound], p))
        same = (n[near] * limit.den >= n[p] * limit.num) & (n[near] * limit.num <= n[p] * limit.den)
        left[near[(far <= bound) & same]] = False
        rest = np.flatnonzero(left)
        if not len(rest) or (done.label[rest] == done.label[rest[0]]).all():
            break
    return done


def _groups(batches, keys: int):
    """Tables of the rows of one key each, from batches sorted by the first ``keys`` columns."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if now is not None and first != now:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        now = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of_blocks(df: DataFrame, blocks: str, row: str = "id") -> DataFrame:
    """A group of several blocks is dealt as pairs of blocks (i <= j): every two
    rows meet, and a task holds two blocks at most."""
    own = F.pmod(F.xxhash64(row), F.col(blocks))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1),
                       lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return df.withColumn("p", F.explode(pair)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p", blocks)


def _emit(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.zeros(0, np.int64)])),
                                       pa.array(np.concatenate(b or [np.zeros(0, np.int64)]))], ["a", "b"])


def likely_links(reps: DataFrame, limit: Threshold) -> DataFrame:
    """Links (a, b) whose components hold together all sets that can link.
    N-grams of one prefix alone stay where they are: a bit filter of the others
    is made first."""

    def prefixes(batches):
        yield from packed_hashes((batch.column(0).flatten().to_numpy(zero_copy_only=False) for batch in batches), SHARED_BITS)

    spark = reps.sparkSession
    twice = spark.sparkContext.broadcast(repeat_filter(reps.select("prefix").mapInArrow(prefixes, PACKED), SHARED_BITS))

    def met(batches):
        for batch in batches:
            prefix = batch.column(0)
            token = prefix.flatten().to_numpy(zero_copy_only=False)
            ids = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), prefix.value_lengths().to_numpy(zero_copy_only=False))
            maybe = in_bits(twice.value, token)
            yield pa.RecordBatch.from_arrays([pa.array(token[maybe]), pa.array(ids[maybe])], ["token", "id"])

    tokens = reps.select("prefix", "id").mapInArrow(met, "token long, id long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = tokens.join(shared, "token").withColumn("blocks", F.ceil(F.col("c") / BUCKET_ROWS).cast("long"))
    rows = rows.select("token", "id", "blocks").join(reps.select("id", "n", "bitmap"), "id")
    rows = _pairs_of_blocks(rows, "blocks").select("token", "i", "j", "n", "id", "bitmap")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "id")

    def small(n, ids, maps):
        at = list(range(len(n)))
        for x in range(len(n)):
            for y in range(x + 1, len(n)):
                if n[x] * limit.den < n[y] * limit.num:
                    break
                if at[x] == at[y]:
                    continue
                p, q = maps[x], maps[y]
                if len(p) != len(q):
                    half = len(q) // 2
                    q = bytes(u ^ v for u, v in zip(q[:half], q[half:])) if half == len(p) else None
                    if q is None:
                        continue
                if (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count() <= limit.apart(n[x], n[y]):
                    old, new = max(at[x], at[y]), min(at[x], at[y])
                    at = [new if v == old else v for v in at]
                    yield ids[x], ids[y]

    def run(batches):
        a, b = [], []
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            if t.num_rows <= 8:
                found = list(small(t.column("n").to_pylist(), t.column("id").to_pylist(), t.column("bitmap").to_pylist()))
                if found:
                    a.append(np.array([x for x, _ in found], np.int64))
                    b.append(np.array([y for _, y in found], np.int64))
            else:
                near = close_sets(t.column("n").to_numpy(), t.column("bitmap").to_pylist(), limit)
                x, y = near.links(t.column("id").to_numpy())
                a.append(x)
                b.append(y)
            if len(a) >= 1000:
                yield _emit(a, b)
                a, b = [], []
        yield _emit(a, b)

    return rows.mapInArrow(run, "a long, b long").where("a <> b")


class Trie:
    """Sets of weighted items in one order, most shared first, as a trie by levels.

    Items that the same sets hold are one item with their number as weight;
    items of a single set are left out (they overlap with nothing).  A level
    lists its nodes: parent in the level above, item, the smallest set below,
    and the largest weight still to come below.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        _, item = np.unique(flat, return_inverse=True)
        count = np.bincount(item)
        tags = mix64(np.arange(1, len(sets) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        pattern = np.zeros(len(count), np.uint64)
        np.add.at(pattern, item, tags[owner])
        _, first, of, weight = np.unique(pattern, return_index=True, return_inverse=True, return_counts=True)
        held = count[first]
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((first, -held))] = np.arange(len(first))
        self.weight = np.empty(len(first), np.int64)
        self.weight[rank] = weight
        shared = held[of[item]] > 1
        pair = np.unique(owner[shared] * len(first) + rank[of[item]][shared])
        self.owner, self.item = pair // len(first), pair % len(first)
        self.cut = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        self.levels = []
        self._build()

    def _build(self):
        n = len(self.size)
        node, depth = np.zeros(n, np.int64), np.diff(self.cut)
        weights = self.weight[self.item]
        total = np.concatenate([[0], np.cumsum(weights)])
        self.held = total[self.cut[1:]] - total[self.cut[:-1]]
        alive, d = np.arange(n), 0
        self.ends = [(alive[depth == 0], node[alive[depth == 0]])]
        while True:
            alive = alive[depth[alive] > d]
            if not len(alive):
                break
            item = self.item[self.cut[alive] + d]
            key = node[alive] * (len(self.weight) + 1) + item
            nodes, first, at = np.unique(key, return_index=True, return_inverse=True)
            node[alive] = at
            rest = self.held[alive] - (total[self.cut[alive] + d + 1] - total[self.cut[alive]])
            smallest = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(smallest, at, self.size[alive])
            longest = np.zeros(len(nodes), np.int64)
            np.maximum.at(longest, at, rest)
            d += 1
            end = alive[depth[alive] == d]
            self.ends.append((end, node[end]))
            self.levels.append((nodes // (len(self.weight) + 1), item[first], smallest, longest))

    def items(self, s: int) -> np.ndarray:
        return self.item[self.cut[s]:self.cut[s + 1]]

    def linked(self, s: int, limit: Threshold) -> np.ndarray:
        """The sets that link to set s, by one walk from the root."""
        own = self.items(s)
        gain = np.zeros(len(self.weight) + 1, np.int64)
        gain[own] = self.weight[own]
        after = self.held[s] - np.cumsum(gain[:-1])  # of s, behind each item
        size, out = self.size[s], []
        ends, nodes = self.ends[0]
        overlap, alive = np.zeros(1, np.int64), np.ones(1, bool)
        if len(ends) and limit.linked(0, size, 1):
            out.append(ends)
        for (parent, item, smallest, longest), (ends, nodes) in zip(self.levels, self.ends[1:]):
            overlap = overlap[parent] + gain[item]
            best = overlap + np.minimum(after[item], longest)
            alive = alive[parent] & (best >= limit.least_overlap(size, smallest))
            if not alive.any():
                break
            ok = alive[nodes] & limit.linked(overlap[nodes], size, self.size[ends])
            out.append(ends[ok])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def join_block(sets: list[np.ndarray], limit: Threshold) -> Union:
    """Joins all sets of a block that are linked, directly or through others.

    Sets are walked from the most shared on; the walks end when those not yet
    walked are all joined, as only two of them could still give a link.
    """
    done = Union(len(sets))
    if len(sets) == 2:
        overlap = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if limit.linked(overlap, len(sets[0]), len(sets[1])):
            done.join(np.array([0, 1]))
        return done
    trie = Trie(sets)
    per = np.bincount(trie.item, minlength=len(trie.weight)) * trie.weight
    middle = np.bincount(trie.owner, per[trie.item], len(sets)) / np.maximum(trie.size, 1)
    left = np.ones(len(sets), bool)
    for s in np.argsort(-middle, kind="stable"):
        left[s] = False
        done.join(np.append(trie.linked(s, limit), s))
        rest = done.label[left]
        if not len(rest) or (rest == rest[0]).all():
            break
    return done


def verified_links(rows: DataFrame, label: DataFrame, heads: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """Links between sets of each block whose Jaccard similarity holds.  A
    set's tokens are read from a row with the id and the set of its head."""
    spark = rows.sparkSession
    who = heads.select("id", "n", F.col("rep").alias("r"), "s1", "s2").join(label, "id")
    bits = spark.sparkContext.broadcast(bit_filter(who.select(F.xxhash64("r")), ID_BITS))

    def tokens(batches):
        for batch in batches:
            maybe = in_bits(bits.value, batch.column(2).to_numpy(zero_copy_only=False))
            picked = batch.filter(pa.array(maybe))
            for at, data, offsets in text_blocks(picked.column(1)):
                s = Sets(data, offsets, n)
                raw = s.token.astype("<u8").tobytes()
                cuts = s.offsets.tolist()
                s1, s2 = s.sums()
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0).slice(at, len(s1)), pa.array(s1), pa.array(s2),
                     pa.array([raw[8 * a:8 * b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["r", "s1", "s2", "tokens"])

    sets = rows.select("id", "t", F.xxhash64("id").alias("h")).mapInArrow(tokens, "r long, s1 long, s2 long, tokens binary")
    total = who.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("long").alias("blocks"))
    sets = sets.join(who.join(total, "component").drop("n"), ["r", "s1", "s2"])
    blocks = _pairs_of_blocks(sets, "blocks").select("component", "i", "j", "id", "tokens")
    blocks = blocks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")

    def run(batches):
        a, b = [], []
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            x, y = join_block([np.frombuffer(v, "<u8") for v in t.column("tokens").to_pylist()], limit).links(t.column("id").to_numpy())
            a.append(x)
            b.append(y)
            if len(a) >= 1000:
                yield _emit(a, b)
                a, b = [], []
        yield _emit(a, b)

    return blocks.mapInArrow(run, "a long, b long").where("a <> b")


def _near(docs: DataFrame, n: int, limit: Threshold, id_col: str, text_col: str, with_least: bool) -> DataFrame:
    """(id, x, n, label, least) of every row: x a hash of its text, label that
    of its component, least the smallest id in it, if asked for.  Nodes are sets: named by
    their smallest id, or, where several sets have the same, all but one by a hash."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    order = Order(frequent_grams(rows.select("t"), n))
    order = Order(order.hot, shared_grams(rows.select("t"), n, limit, order))
    sets = written(all_sets(rows.withColumn("x", F.xxhash64("t")), n, limit, order), "sets")
    real = sets.where("n > 0 and id is not null")
    key = F.struct("s1", "s2", "n")
    same = real.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    shared = same.groupBy("rep").agg(F.count(F.lit(1)).alias("sets"), F.min(key).alias("first")).where("sets > 1")
    same = same.join(shared.select(F.col("rep").alias("of"), "first"), F.col("rep") == F.col("of"), "left").select(
        "s1", "s2", "n", "rep", F.when(F.col("of").isNull() | (F.col("first") == key), F.col("rep")).otherwise(F.xxhash64("s1", "s2", "n")).alias("node"),
        ((F.col("rows") > 1) | F.col("of").isNotNull()).alias("odd"))
    same = written(same, "equal-sets")
    # a set of one row that alone has its id is its own head, and stays in the table of sets
    h = F.xxhash64("s1", "s2", "n")
    heads = sets.where((F.lit(limit.den) * F.col("n") >= F.lit(limit.num) * (F.col("n") + 1)) & F.col("id").isNotNull()).drop("x")
    heads = maybe_in(heads, h, same.where("odd").select(h))
    odd = heads.where("maybe").join(same, ["s1", "s2", "n"]).where("id = rep")
    odd = odd.select(F.col("node").alias("id"), "rep", "s1", "s2", "n", "bitmap", "prefix").dropDuplicates(["id"])
    heads = heads.where("not maybe").withColumn("rep", F.col("id")).drop("maybe").unionByName(written(odd, "set-heads"))
    same = same.drop("odd")
    label = written(components(likely_links(heads, limit)), "blocks")
    links = components(verified_links(rows, label, heads, n, limit)).select(F.col("id").alias("node"), "component")
    node = same.join(links, "node", "left").select("s1", "s2", "n", "rep", F.coalesce("component", "node").alias("label"))
    rows = sets.select("id", "x", "n", "s1", "s2")
    if not with_least:
        return rows.join(node.drop("rep"), ["s1", "s2", "n"], "left").select("id", "x", "n", "label")
    node = written(node, "nodes")
    least = node.groupBy("label").agg(F.min("rep").alias("least"))
    node = node.join(least, "label").select("s1", "s2", "n", "label", "least")
    return rows.join(node, ["s1", "s2", "n"], "left").select("id", "x", "n", "label", "least")


def near_components(docs: DataFrame, n: int = 3, limit: Threshold = Threshold(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (size of its set of word
    ``n``-grams), component_id (the smallest id that links reach).

    A-Z are lower-cased; words are runs without U+0020, U+0009-U+000D; a text
    of fewer than ``n`` words is one n-gram; null and empty texts have none
    and link to nothing.  A row with a null id links to nothing and gets a null
    component.  Links are between texts: rows that repeat an id with another
    text are rows of their own, linked only if their texts are.  Extra columns
    are ignored; an empty table gives no rows.  N-grams are compared by 64-bit
    hashes, whole sets by 128-bit hashes.
    """
    known = F.col("id").isNotNull()
    return _near(docs, n, limit, id_col, text_col, True).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(known, F.coalesce("least", "id")).alias("component_id"))


def near_copies(docs: DataFrame, n: int = 3, limit: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of the rows that are linked, over any number of links, with the
    row of their component that stays, that of the smallest id (ties: smallest
    x); x is xxhash64 of the text (null: empty).  Rows as in ``near_components``."""
    rows = _near(docs, n, limit, id_col, text_col, False).where("id is not null and label is not null")
    rows = written(rows.select("id", "x", "label"), "near-rows")
    stays = rows.groupBy("label").agg(F.min(F.struct("id", "x")).alias("stays"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return rows.join(stays.select("label", "stays"), "label").where(F.struct("id", "x") != F.col("stays")).select("id", "x")
