"""Ratio of matching blocks: hand-written pairs around the cutoff, and the standard library's matcher as a checker."""

import difflib
import random

from pyspark.sql import functions as F

from fiscus.functions.blocks import best_block_match, block_ratio

#: x, y, matched characters
PAIRS = [
    ("value", "value", 5), ("country", "contry", 6), ("sector", "sectors", 6), ("year", "yaer", 3), ("indicator_id", "indicatorid", 11),
    ("country_name", "name_country", 7), ("abcd", "bcde", 3), ("private", "thread", 2), ("", "a", 0), ("a", ""  , 0), ("ab", "ba", 1),
    ("observation", "observations_", 11), ("unit", "until", 3), ("abxcd", "abcd", 4), ("aaaa", "aa", 2), ("source", "sauce", 4), ("é_name", "e_name", 5)]


def test_matched_characters(spark):
    d = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(PAIRS)], "i int, x string, y string")
    got = {r.i: r.r for r in d.select("i", block_ratio(F.col("x"), F.col("y")).alias("r")).collect()}
    for i, (x, y, m) in enumerate(PAIRS):
        assert abs(got[i] - 2 * m / (len(x) + len(y))) < 1e-12, (x, y)
        assert (got[i] >= 0.8) == (10 * m >= 4 * (len(x) + len(y)))
    assert spark.range(1).select(block_ratio(F.lit(""), F.lit(""))).first()[0] == 1.0


def test_ratio_and_best_match_like_the_library(spark):
    rng = random.Random(6)
    names = ["country_id", "country_name", "sector_id", "sector", "indicator", "indicator_id", "value", "year", "abab"]
    words = ["".join(rng.choices("abc_", k=rng.randint(0, 9))) for _ in range(60)]
    for n in names:
        for _ in range(6):
            w = list(n)
            for _ in range(rng.randint(0, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice("aeiot_")) if rng.random() < 0.5 else w.pop(rng.randrange(len(w)))
            words.append("".join(w))
    d = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", best_block_match(F.col("w"), names).alias("m"), block_ratio(F.reverse("w"), F.col("w")).alias("r"))
    for r in d.collect():
        close = difflib.get_close_matches(r.w, names, n=1, cutoff=0.8)
        assert ([r.m.name] if r.m else []) == close, r.w
        assert abs(r.r - difflib.SequenceMatcher(None, r.w[::-1], r.w).ratio()) < 1e-12, r.w
