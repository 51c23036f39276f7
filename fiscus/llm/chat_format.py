"""Conversations as training text with a loss mask on tokens.

Turns are rendered between the marks of a template; what looks like a mark
inside a text is escaped, so the text can be read back.  Whole renderings are
encoded once, with the character span of every token; the spans of the turns
to learn from, sorted as they come, meet the token spans by binary search.
Marks are tokens of their own, so no token stands across the edge of a turn.

Conversations that lie whole in a task are rendered there; the others, cut at
task ends or every ``part_chars`` characters between turns, are rendered in
parts (the marks make the tokens of the parts those of the whole).
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.bpe import read_ranks
from fiscus.llm.common import ship, written
from fiscus.llm.conversations import in_order, stretches, turns

FORMATTED = "conv long, part long, whole boolean, text string, ids binary, starts binary, ends binary, mask binary"
READ = ("conv long, part long, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, turns binary, loss binary")


_MARKS = tuple(".,;:!?")


@dataclass(frozen=True)
class Template:
    """Marks before and behind a turn by role, marks of the turns of any other
    role (before the role, between role and text, behind), further strings
    that the tokenizer knows, and the roles under the loss."""

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[ROLE]", "[SAYS]", "[/ROLE]")
    reserved: tuple = ("<|endoftext|>",)
    learn: tuple = ("assistant",)

    def __post_init__(self):
        strings = self.controls()
        for a in strings:
            for b in strings:
                if "\\" in a or len(a) < 2 or a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings must not hold a backslash, each other, or each other's ends: {a} {b}")

    def controls(self) -> list[str]:
        """All strings with a meaning, marks first."""
        return list(dict.fromkeys([m for pair in self.marks.values() for m in pair] + [*self.other, *self.reserved]))

    def special(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, self.controls())) + ")")

    def escape(self, text: str) -> str:
        """A backslash is doubled; one goes behind the first character of a control string."""
        if "\\" not in text and not any(c in text for c in self.controls()):
            return text
        return re.sub(r"(\\)|" + self.special().pattern, lambda m: "\\\\" if m[1] else f"{m[2][0]}\\{m[2][1:]}", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def render(self, rows: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of turns (role, text) and the sorted character spans of the texts to learn."""
        out, at, spans = [], 0, []
        for role, text in rows:
            before, behind = self.marks.get(role, (None, None))
            if before is None:
                before, behind = self.other[0] + self.escape(role) + self.other[1], self.other[2]
            inside = self.escape(text)
            at += len(before)
            if role in self.learn:
                spans.append((at, at + len(inside)))
            at += len(inside) + len(behind)
            out += (before, inside, behind)
        return "".join(out), spans

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a rendered text."""
        roles = {pair[0]: role for role, pair in self.marks.items()}
        pieces = self.special().split(text)
        out, i = [], 1
        while i < len(pieces):
            if pieces[i] == self.other[0]:
                out.append((self.unescape(pieces[i + 1]), self.unescape(pieces[i + 3])))
                i += 6
            else:
                out.append((roles[pieces[i]], self.unescape(pieces[i + 1])))
                i += 4
        return out


class OffsetEncoder:
    """Ids and character spans of texts.  Control strings are tokens numbered
    behind the vocabulary.  What stands between is cut by the pattern; runs
    between single blanks, which the pattern always cuts there, and lines are
    kept with their ids in a bounded table."""

    def __init__(self, ranks: list, pattern: str, controls: list[str], keep: int = 300_000):
        import regex
        import tiktoken

        self.one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})._encode_single_piece
        self.find, self.keep, self.known = regex.compile(pattern).findall, keep, {}
        base = max(r for _, r in ranks) + 1
        self.control = {c: np.array([base + i], "<u4").tobytes() for i, c in enumerate(controls)}
        self.split = re.compile("(" + "|".join(map(re.escape, controls)) + ")").split
        self.bytes = np.zeros(base + len(controls), np.int64)
        for token, rank in ranks:
            self.bytes[rank] = len(token)
        self.bytes[base:] = [len(c.encode()) for c in controls]
        self.blanks = re.compile(r"\s\s").search

    def _ids(self, text: str) -> bytes:
        """Ids of a text without regard to blanks, as little-endian 32-bit numbers."""
        ids = [i for p in self.find(text) for i in self.one(p.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _kept(self, text: str) -> bytes:
        """Ids of a run.  Latin letters behind at most one blank are one match
        of the pattern, a mark behind them another."""
        ids = self.known.get(text)
        if ids is None:
            plain = text[1:] if text[:1] == " " else text
            if plain.isalpha() and max(plain) < "\u0250":
                ids = self.one(text.encode())
                ids = struct.pack(f"<{len(ids)}I", *ids)
            elif plain[-1:] in _MARKS and plain[:-1].isalpha() and max(plain) < "\u0250":
                ids = self._kept(text[:-1]) + self._kept(text[-1])
            else:
                ids = self._ids(text)
            if len(self.known) >= self.keep:
                self.known.clear()
            if len(text) < 100:
                self.known[text] = ids
        return ids

    def _lines(self, run: str) -> bytes:
        """Ids of a run without blanks but its first; single line feeds are tokens of their own."""
        if "\n" not in run:
            return self._kept(run)
        first, *rest = run.split("\n")
        return self._kept(first) + b"".join([self._kept("\n") + self._kept(x) for x in rest])

    def _between(self, text: str) -> list[bytes]:
        if self.blanks(text):
            return [self._ids(text)]
        get, (first, *rest) = self.known.get, text.split(" ")
        runs = [" " + r for r in rest]
        found = [get(r) for r in runs]
        return [self._lines(first), *(f if f is not None else self._lines(r) for r, f in zip(runs, found))]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends): a token that holds part of a character has the span of the character."""
        out: list[bytes] = []
        for i, piece in enumerate(self.split(text)):
            if i % 2:
                out.append(self.control[piece])
            elif piece:
                out += self._between(piece)
        ids = np.frombuffer(b"".join(out), "<u4").astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        if text.isascii():
            return ids, edge[:-1], edge[1:]
        chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return ids, chars[edge[:-1]] - 1, chars[edge[1:] - 1]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that share a character with one of the sorted spans: each
    span's first and last token are found by binary search."""
    mask = np.zeros(len(starts), np.uint8)
    if spans:
        a, b = np.array(spans).T
        for x, y, s, e in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"), a, b):
            if s < e:
                mask[x:y] = 1
    return mask


def format_conversations(rows: DataFrame, ranks_path: str, pattern: str, template: Template = Template(), conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = 1 << 20) -> DataFrame:
    """FORMATTED rows: rendered text, token ids, first and last character of
    every token (end exclusive), all as little-endian 32-bit, and a mask byte
    a token (1: under the loss).  A conversation is one row, or several with
    ``whole`` false, in order of ``part``.

    Turns come by number, null numbers first; rows that repeat a number stand
    in order of a hash of role and text; repeated rows are turns each.  Null
    texts and roles are empty; any role is kept; a null conversation id is a
    conversation; empty texts have no masked token; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    d = in_order(turns(rows, conv_col, turn_col, role_col, text_col)).select(
        "conv", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        encoder = OffsetEncoder(ranks.value, pattern, template.controls())
        for part, conv, held, whole in stretches(batches, lambda r: len(r[1]) + len(r[2]), part_chars):
            text, spans = template.render([r[1:] for r in held])
            ids, starts, ends = encoder.encode(text)
            mask = token_mask(starts, ends, spans)
            yield conv, part, whole, text, *(x.astype("<u4").tobytes() for x in (ids, starts, ends)), mask.tobytes()

    return d.mapInArrow(_batched(run, FORMATTED), FORMATTED)


def _kind(name: str) -> pa.DataType:
    return {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[name]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _kind(k)) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def _batched(run, schema: str, most_bytes: int = 4 << 20):
    """``run``, which yields rows, as a function that yields batches of about ``most_bytes``."""

    def batches(source):
        held, size = [], 0
        for row in run(source):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if size >= most_bytes or len(held) >= 10_000:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    return batches


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text under the mask: spans that touch or overlap are one."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    s, e = starts[at].astype(np.int64), ends[at].astype(np.int64)
    new = np.append(True, s[1:] > np.maximum.accumulate(e)[:-1])
    first = np.flatnonzero(new)
    return [text[a:b] for a, b in zip(s[first].tolist(), np.maximum.reduceat(e, first).tolist())]


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from FORMATTED rows alone: conv, n_turns, turns_sha256
    (role, line feed, text, line feed of every turn), loss_chars and
    loss_sha256 (all text under the mask, unescaped), formatted_chars.

    Whole conversations are finished where they are read.  The turns of the
    others move, and one task runs through each in order, holding one part:
    a digest of a whole conversation has no other form.
    """
    ship(formatted.sparkSession)

    def run(batches):
        for batch in batches:
            for conv, part, whole, text, _, starts, ends, mask in zip(*(c.to_pylist() for c in batch.columns)):
                said = template.parse(text)
                everything = "".join(f"{r}\n{t}\n" for r, t in said).encode()
                learnt = "".join(template.unescape(x) for x in masked_text(
                    text, np.frombuffer(starts, "<u4"), np.frombuffer(ends, "<u4"), np.frombuffer(mask, np.uint8)))
                row = (conv, part, whole, len(said), None, len(learnt), None, len(text), everything, learnt.encode())
                if whole:
                    row = (*row[:4], hashlib.sha256(row[8]).hexdigest(), row[5], hashlib.sha256(row[9]).hexdigest(), row[7], None, None)
                yield row

    def fold(batches):
        conv, sums, one, two = None, None, None, None
        for batch in batches:
            for c, _, _, n, _, m, _, chars, said, learnt in zip(*(x.to_pylist() for x in batch.columns)):
                if sums is None or c != conv:
                    if sums:
                        yield conv, None, True, sums[0], one.hexdigest(), sums[1], two.hexdigest(), sums[2], None, None
                    conv, sums, one, two = c, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                sums = [x + y for x, y in zip(sums, (n, m, chars))]
                one.update(said)
                two.update(learnt)
        if sums:
            yield conv, None, True, sums[0], one.hexdigest(), sums[1], two.hexdigest(), sums[2], None, None

    read = written(formatted.select(*[f.split()[0] for f in FORMATTED.split(", ")]).mapInArrow(_batched(run, READ), READ), "conversations-read")
    parts = read.where(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_batched(fold, READ), READ)
    return read.where("whole").unionByName(parts).drop("part", "whole", "turns", "loss")
