"""Repair of conversation structure with the cheapest, then ASCII-least audit.

A dynamic program runs over the rows of a conversation with four states:
nothing kept yet, after a system, a user, an assistant turn.  Audits (one
letter per edit) are persistent: an edit is a node linked to the edits before
it, so states share their prefixes.  Nodes have binary-lifting ancestors and
a rolling hash of all letters up to them; of two audits of equal cost, the
search for their longest common prefix climbs both to the first letter that
differs, and the prefixes found equal by hash are compared letter by letter
as far as they are different nodes.  Audits of equal cost at the same row and
state never are prefixes of each other: the longer one would hold insertions
more, and cost more.

A conversation that lies whole in a task is repaired there.  One that is cut
(task ends, ``part_rows`` rows) gives for each part the best audit between any
two states; the parts are put together in order, then the texts run through
one task, a row at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.common import ship, written
from fiscus.llm.conversations import in_order, stretches, turns

NONE, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SOUND, CUT, BLANK, AGAIN = range(4)
#: State after a turn of a role (first letter), None where it may not stand.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
FREE = (USER, USER, ASSISTANT, USER)
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORT = f"struct<{COUNTS.replace(' long', ':long').replace(' string', ':string')}>"
#: A row of the result: a repaired turn (place, role, text), or, without place, the report of its conversation.
#: Parts of cut conversations (kind 1: counts and audits, kind 2: its rows) never leave this module.
STEP = f"conv long, kind int, part long, place long, role string, text string, report {REPORT}, payload binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_REPORT = pa.struct([(n, _TYPES[k]) for n, k in (f.split() for f in COUNTS.split(", "))])
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Edit strings as nodes that share prefixes; node 0 is the empty string."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        """The string of ``node`` and one letter more."""
        up, lift, k = [node], node, 0
        while len(self.up[lift]) > k:
            lift = self.up[lift][k]
            up.append(lift)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        self.up.append(up)
        return len(self.up) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _lifted(self, node: int, depth: int) -> int:
        k = 0
        rest = self.depth[node] - depth
        while rest:
            if rest & 1:
                node = self.up[node][k]
            rest >>= 1
            k += 1
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal, letter by letter down to a shared node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """a < b as strings."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, depth), self._lifted(b, depth)
        if x == y or self.hash[x] == self.hash[y] and self._equal(x, y):
            return self.depth[a] < self.depth[b]
        if self.hash[x] != self.hash[y]:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]):
                    p, q = self.up[x][k], self.up[y][k]
                    if self.hash[p] != self.hash[q]:
                        x, y = p, q
            if self.letter[x] != self.letter[y] and self._equal(self.up[x][0], self.up[y][0]):
                return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # hashes collide


def _offer(best: list, audits: Audits, state: int, cost: int, node: int, letter: str) -> bool:
    """Take an edit as the best way to ``state`` if it is."""
    old = best[state]
    if old is not None:
        if cost > old[0]:
            return False
        if cost == old[0]:
            new = audits.add(node, letter)
            if not audits.less(new, old[1]):
                return False
            best[state] = (cost, new)
            return True
    best[state] = (cost, audits.add(node, letter))
    return True


def _insert(best: list, audits: Audits) -> None:
    more = True
    while more:
        more = False
        for state in range(4):
            if best[state] is not None:
                more |= _offer(best, audits, FREE[state], best[state][0] + INSERT, best[state][1], "I")


def cheapest(rows: list[tuple[str, int]], start: int, audits: Audits) -> list:
    """(cost, node) of the best audit from ``start`` to each state, or None, of
    rows (first letter of the role, fault)."""
    best: list = [None] * 4
    best[start] = (0, 0)
    _insert(best, audits)
    for letter, fault in rows:
        before, best = best, [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            if before[state] is None:
                continue
            cost, node = before[state]
            _offer(best, audits, state, cost + DELETE, node, "D")
            if fault < BLANK:
                kept = NEXT.get(letter, (None,) * 4)[state]
                if kept is not None:
                    _offer(best, audits, kept, cost + extra, node, "K")
                _offer(best, audits, FREE[state], cost + extra + REROLE, node, "R")
        _insert(best, audits)
    return best


def applied(audit: str, state: int, rows):
    """The repaired turns (role, text) of an audit; ``rows`` yields (role, text)."""
    rows = iter(rows)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = NEXT[role[0]][state] if edit == "K" else FREE[state]
        yield (role if edit == "K" else "assistant" if state == ASSISTANT else "user"), text


class Counts:
    """What the report counts; parts are added in order."""

    def __init__(self, rows=()):
        numbers = [t for t, _, _ in rows if t is not None]
        self.low, self.high = (numbers[0], numbers[-1]) if numbers else (None, None)
        self.distinct = len(set(numbers))
        self.faults = [0, 0, 0, 0]
        for _, _, fault in rows:
            self.faults[fault] += 1
        letters = [letter for _, letter, _ in rows]
        self.first, self.last = (letters[0], letters[-1]) if letters else (None, None)
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))

    def add(self, o: "Counts") -> None:
        self.distinct += o.distinct - (self.high is not None and self.high == o.low)
        self.low = o.low if self.low is None else self.low
        self.high = self.high if o.high is None else o.high
        self.faults = [a + b for a, b in zip(self.faults, o.faults)]
        if self.last is not None and o.first is not None:
            self.illegal += self.last + o.first not in ("su", "ua", "au")
        self.illegal += o.illegal
        self.first = o.first if self.first is None else self.first
        self.last = self.last if o.last is None else o.last

    def report(self, cost: int, audit: str, sha: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[AGAIN], "truncated": self.faults[CUT],
                "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


class Path:
    """Audits of consecutive parts; the last part and the path before it."""

    def __init__(self, before, entry: int, audit: str):
        self.before, self.entry, self.audit, self.parts = before, entry, audit, 1 + (before.parts if before else 0)

    def less(self, other) -> bool:
        mine, theirs, a, b = [], [], self, other
        while a is not b:  # both have as many parts
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def extended(best: list, matrix: list) -> list:
    """``best`` ((cost, path) per state) after a part with ``matrix[entry][exit]`` (cost, audit)."""
    out: list = [None] * 4
    for entry, way in enumerate(best):
        if way is None:
            continue
        for leave, step in enumerate(matrix[entry]):
            if step is not None:
                cost, path = way[0] + step[0], Path(way[1], entry, step[1])
                if out[leave] is None or cost < out[leave][0] or cost == out[leave][0] and path.less(out[leave][1]):
                    out[leave] = (cost, path)
    return out


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"conv": pa.int64(), "kind": pa.int32(), "part": pa.int64(), "place": pa.int64(), "role": pa.string(), "text": pa.string(),
             "report": _REPORT, "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], list(kinds))


class _Out:
    """Result rows of repaired turns, with the digest of ``role:text`` lines."""

    def __init__(self, conv, turns: bool):
        self.conv, self.turns, self.place, self.sha = conv, turns, 0, hashlib.sha256()

    def put(self, said):
        for role, text in said:
            self.sha.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            if self.turns:
                yield {"conv": self.conv, "kind": 0, "place": self.place, "role": role, "text": text}
            self.place += 1

    def end(self, counts: Counts, cost: int, audit: str) -> dict:
        return {"conv": self.conv, "kind": 0, "report": counts.report(cost, audit, self.sha.hexdigest())}


def _pressed(value) -> bytes:
    import pickle

    return pickle.dumps(value)


def _unpressed(data: bytes):
    import pickle

    return pickle.loads(data)


def _batches(rows, most: int = 4096):
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= most or r.get("payload"):
            yield _rows(held)
            held = []
    if held:
        yield _rows(held)


def marked(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present) -> DataFrame:
    """(conv, turn, digest, row, role, text, fault, present) in order, faults
    without repeats.  Of rows with the same role and text, those of a later
    turn than the first stand behind a mark, a row with ``row`` 0 and the same
    turn and digest; the mark finds its place by the order of the rows, so
    that no text moves for it."""
    d = turns(rows, conv_col, turn_col, role_col, text_col, present.alias("present"))
    light = d.where("present").select("conv", "digest", "turn")
    turn = F.struct("turn")
    several = light.groupBy("conv", "digest").agg(F.min(turn).alias("a"), F.max(turn).alias("z")).where("NOT (a <=> z)")
    several = written(several.select(F.col("conv").alias("c"), F.col("digest").alias("g"), F.col("a.turn").alias("first")), "repeated-turns")
    marks = light.join(several, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g"))).where("NOT (turn <=> first)")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), SOUND).otherwise(CUT))
    d = d.select("conv", "turn", "digest", F.lit(1).alias("row"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "present")
    nothing = F.lit("")
    both = d.select("conv", "turn", "digest", "row", "role", "text", fault.alias("fault"), "present").unionByName(
        marks.select("conv", "turn", "digest", F.lit(0).alias("row"), nothing.alias("role"), nothing.alias("text"), F.lit(AGAIN).alias("fault"), F.lit(False).alias("present")))
    return in_order(both, "row")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present_col: str | None = None, with_turns: bool = True, part_rows: int = 10_000) -> DataFrame:
    """Repaired conversations: rows (conv, place, role, text) of the turns that
    stay, with roles ``(system? (user assistant)+)?``, and one row per
    conversation without place, whose ``report`` holds the counts of faults
    and the audit.

    Turns come by number, null numbers first; rows that repeat a number stand
    in order of a hash of role and text; of equal rows the first is sound and
    the others are duplicates.  Null roles and texts are empty; a role is
    judged by its first letter, others than s, u, a (and empty ones) may not
    stand; null conversation ids are one conversation.  Rows whose
    ``present_col`` is false only name their conversation: one without other
    rows has a report of zeros.  Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    ship(rows.sparkSession)
    present = F.coalesce(F.col(f"`{present_col}`").cast("boolean"), F.lit(True)) if present_col else F.lit(True)
    d = marked(rows, conv_col, turn_col, role_col, text_col, present)

    def steps(batches):
        last = None
        for part, conv, held, whole in stretches(batches, lambda r: 1, part_rows):
            said, light = [], []
            for _, turn, digest, _, role, text, fault, there in held:
                if not there and fault != AGAIN:
                    continue
                if there and fault != BLANK and last == (conv, turn, digest):
                    fault = AGAIN
                last = (conv, turn, digest)
                if not there:
                    continue
                said.append((role, text))
                light.append((turn, role[:1], fault))
            counts, plain = Counts(light), [r[1:] for r in light]
            if whole:
                audits, out = Audits(), _Out(conv, with_turns)
                best = cheapest(plain, NONE, audits)
                cost, audit = min((best[s][0], audits.text(best[s][1])) for s in (NONE, ASSISTANT) if best[s])
                yield from out.put(applied(audit, NONE, said))
                yield out.end(counts, cost, audit)
            else:
                matrix = []
                for start in range(4):
                    audits = Audits()
                    matrix.append([b and (b[0], audits.text(b[1])) for b in cheapest(plain, start, audits)])
                yield {"conv": conv, "kind": 1, "part": part, "payload": _pressed((counts, matrix))}
                yield {"conv": conv, "kind": 2, "part": part, "payload": _pressed(said)}

    def fold(batches):
        def done():
            yield out.end(counts, *chosen)

        conv, out, begun = None, None, False
        for batch in batches:
            for c, kind, payload in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "payload"))):
                if not begun or c != conv:
                    if begun:
                        yield from done()
                    conv, begun, out, counts, chosen, ways = c, True, _Out(c, with_turns), Counts(), None, None
                    best = [(0, None), None, None, None]
                value = _unpressed(payload)
                if kind == 1:
                    counts.add(value[0])
                    best = extended(best, value[1])
                    continue
                if ways is None:
                    ways, audits = [], []
                    a, b = best[NONE], best[ASSISTANT]
                    cost, path = min((w for w in (a, b) if w), key=lambda w: w[0])
                    if a and b and a[0] == b[0]:
                        path = a[1] if a[1].less(b[1]) else b[1]
                    while path:
                        ways.append((path.entry, path.audit))
                        path = path.before
                    chosen = cost, "".join(audit for _, audit in reversed(ways))
                entry, audit = ways.pop()
                yield from out.put(applied(audit, entry, value))
        if begun:
            yield from done()

    first = written(d.mapInArrow(lambda b: _batches(steps(b)), STEP), "conversations-repaired")
    parts = first.where("kind > 0").repartition("conv").sortWithinPartitions("conv", "kind", "part")
    rest = parts.mapInArrow(lambda b: _batches(fold(b)), STEP)
    return first.where("kind = 0").unionByName(rest).select("conv", "place", "role", "text", "report").withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with planted faults: by crc32 of ``conv:turn`` mod 20, a
    row is dropped (0; it stays with ``present`` false), emptied (1), loses its
    sentence marks (2), comes twice (3), or speaks as user (4).  Nulls count as one space."""
    name = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    d = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                    name[2].alias("role"), name[3].alias("text"), kind.alias("kind"))
    return d.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
