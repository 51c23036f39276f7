"""Similarity of strings by matching blocks (Ratcliff and Obershelp), as column expressions.

The longest common substring of two strings is taken out; the pieces left of
it, and those right of it, are compared in the same way.  The ratio is twice
the matched length by the length of both.  A work list of pieces takes the
place of the recursion.  Meant for names: the cost grows with the cube of
their length, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STATE = "struct<todo:array<struct<x:string,y:string>>,matched:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def longest_block(x: Column, y: Column) -> Column:
    """struct(k, i, j) of the longest common substring of two strings, x not
    empty: length and places from 1; of several the first in x, then in y."""
    def prefix(i: Column) -> Column:
        return F.array_max(F.filter(F.sequence(F.lit(0), F.length(x) - i + 1), lambda n: F.instr(y, F.substring(x, i, n)) > 0))

    found = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.struct(prefix(i).alias("k"), (-i).alias("back")))
    return _let(F.array_max(found), lambda b: F.struct(
        b["k"].alias("k"), (-b["back"]).alias("i"), F.instr(y, F.substring(x, -b["back"], b["k"])).alias("j")))


def matched_length(x: Column, y: Column) -> Column:
    """Characters of ``x`` in blocks that ``y`` shares."""
    def piece(a: Column, b: Column) -> Column:
        return F.struct(a.alias("x"), b.alias("y"))

    def cut(p: Column, b: Column) -> Column:
        left = piece(F.substring(p["x"], F.lit(1), b["i"] - 1), F.substring(p["y"], F.lit(1), b["j"] - 1))
        right = piece(F.substring(p["x"], b["i"] + b["k"], F.length(p["x"])), F.substring(p["y"], b["j"] + b["k"], F.length(p["y"])))
        return F.filter(F.array(left, right), lambda q: (q["x"] != "") & (q["y"] != ""))

    def step(s: Column, _: Column) -> Column:
        rest = F.slice(s["todo"], F.lit(2), F.greatest(F.size(s["todo"]), F.lit(1)))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(_let(s["todo"][0], lambda p: _let(longest_block(p["x"], p["y"]), lambda b: F.struct(
            F.when(b["k"] > 0, F.concat(rest, cut(p, b))).otherwise(rest).alias("todo"), (s["matched"] + b["k"]).alias("matched")))))

    start = F.struct(F.filter(F.array(piece(x, y)), lambda q: (q["x"] != "") & (q["y"] != "")).alias("todo"), F.lit(0).alias("matched")).cast(_STATE)
    # a block splits a pair into two, and each holds a character at least
    turns = F.sequence(F.lit(0), 2 * F.least(F.length(x), F.length(y)))
    return F.aggregate(turns, start, lambda s, i: step(s, i).cast(_STATE), lambda s: s["matched"])


def block_ratio(x: Column, y: Column) -> Column:
    """Twice the matched length by both lengths; 1 for two empty strings."""
    both = F.length(x) + F.length(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * matched_length(x, y) / both)


def best_block_match(word: Column, names: list[str], cutoff: float = 0.8) -> Column:
    """struct(ratio, name) of the most similar name, NULL under ``cutoff``
    (ties: the last by order).  Names whose length rules the cutoff out are
    not compared.  The list is a schema's names: fixed and small."""
    cand = F.array(*[F.lit(n) for n in names])
    near = F.filter(cand, lambda n: 2.0 * F.least(F.length(n), F.length(word)) >= cutoff * (F.length(n) + F.length(word)))
    scored = F.transform(near, lambda n: F.struct(block_ratio(n, word).alias("ratio"), n.alias("name")))
    return _let(F.array_max(scored), lambda b: F.when(b["ratio"] >= cutoff, b))
