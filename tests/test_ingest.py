"""Ingest decisions of SURVEY 1.4 on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from fiscus.operators import ingest as I


def test_unpivot_years_drops_empty_cells_keeps_zero(spark):
    wide = spark.createDataFrame(
        [("A", "gg", 1.0, None, 0.0), ("B", None, None, 2.5, None)],
        "COUNTRY string, SECTOR string, `1972` double, `1973` double, `1974` double")
    got = sorted(tuple(r) for r in I.unpivot_years(wide, ["COUNTRY", "SECTOR"]).collect())
    assert got == [("A", "gg", 1972, 1.0), ("A", "gg", 1974, 0.0), ("B", None, 1973, 2.5)]


def test_unpivot_pivot_round_trip(spark):
    long = spark.createDataFrame([("A", 2000, 1.0), ("A", 2001, 2.0), ("B", 2000, 3.0)],
                                 "c string, year int, value double")
    wide = long.groupBy("c").pivot("year").agg(F.first("value"))
    back = I.unpivot_years(wide, ["c"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_sorted_surrogate_key_is_consecutive_across_partitions(spark):
    names = spark.range(0, 5000).select(F.format_string("n%05d", (F.col("id") * 7919) % 5000).alias("name"))
    keyed = I.sorted_surrogate_key(names, "name", "id").orderBy("id").collect()
    assert [r.id for r in keyed] == list(range(1, 5001))
    assert [r.name for r in keyed] == sorted(r.name for r in keyed)


def test_dedupe_last_wins_first_position(spark):
    rows = [("C1", "first", "d1", 1), ("C2", "x", "d", 2), ("C1", "second", "d3", 3)]
    df = spark.createDataFrame(rows, "code string, name string, desc string, ord int")
    got = {r.code: (r.first_ord, r.name, r.desc) for r in I.dedupe_last_wins(df, "code", "ord", ["name", "desc"]).collect()}
    assert got == {"C1": (1, "second", "d3"), "C2": (2, "x", "d")}


def test_insert_ignore_existing_wins(spark):
    ex = spark.createDataFrame([("A", "old")], "k string, v string")
    inc = spark.createDataFrame([("A", "new", 1), ("B", "b2", 2), ("B", "b1", 1)], "k string, v string, o int")
    assert sorted(map(tuple, I.insert_ignore(ex, inc, "k", "o").collect())) == [("A", "old"), ("B", "b1")]


def test_upsert_with_offset(spark):
    dim = spark.createDataFrame([(5, "B")], "country_id long, country_name string")
    names = spark.createDataFrame([("C",), ("A",), ("B",), (None,), ("C",)], "country_name string")
    got = sorted(map(tuple, I.upsert_with_offset(dim, names, "country_name", "country_id").collect()))
    assert got == [(5, "B"), (6, "A"), (7, "C")]


def test_lookup_facts_sector_optional(spark):
    long = spark.createDataFrame(
        [("A", "X1", "gg", 2000, 1.0), ("A", "X1", None, 2000, 2.0), ("Z", "X1", "gg", 2000, 3.0),
         ("A", "X9", "gg", 2000, 4.0), ("A", "X1", "gg", 2001, None)],
        "country_name string, indicator_code string, sector_name string, year int, value double")
    c = spark.createDataFrame([(1, "A")], "country_id long, country_name string")
    i = spark.createDataFrame([(10, "X1")], "indicator_id long, indicator_code string")
    s = spark.createDataFrame([(7, "gg")], "sector_id long, sector_name string")
    got = sorted(((r.country_id, r.indicator_id, r.sector_id, r.value)
                  for r in I.lookup_facts(long, c, i, s).collect()), key=repr)
    assert got == sorted([(1, 10, None, 2.0), (1, 10, 7, 1.0)], key=repr)


def test_parse_series_name_and_code(spark):
    files = ["GDP at market prices, current US$, millions, seas. adj..csv",
             "CPI Price, % y-o-y, not seas. adj..csv", "Terms of Trade.csv"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    got = [tuple(r[0]) for r in df.select(I.parse_series_name(F.col("f"))).collect()]
    assert got == [("GDP at market prices", "current US$, millions", True),
                   ("CPI Price", "% y-o-y", False),
                   ("Terms of Trade", None, False)]
    codes = [r[0] for r in df.select(I.series_code(F.col("f"))).collect()]
    assert codes[2] == "GEM_Terms_of_Trade"
    assert len(codes[0]) == 4 + 50


def test_code_truncation_collides(spark):
    a = "A" * 60 + " one.csv"
    b = "A" * 60 + " two.csv"
    df = spark.createDataFrame([(a,), (b,)], "f string")
    assert df.select(I.series_code(F.col("f"))).distinct().count() == 1


def test_safe_cast_reject_per_cell(spark):
    cells = spark.createDataFrame([("2001", "1.5"), ("2001.0", "abc"), ("1971", "2"), ("x", "3"), ("2000", None)],
                                  "y string, v string")
    got = [(r.year, r.value, r.reject_reason) for r in I.safe_cast_reject(cells, "y", "v").collect()]
    assert got == [(2001, 1.5, None), (2001, None, "bad_value"), (1971, 2.0, "year_out_of_range"),
                   (None, 3.0, "bad_year"), (2000, None, "empty_value")]


def test_year_sequence_fills_gaps(spark):
    years = spark.createDataFrame([(1999,), (2003,)], "year int")
    assert [r.year for r in I.year_sequence(years).collect()] == [1999, 2000, 2001, 2002, 2003]


def test_row_number_in_group_matches_window_with_hot_group(spark):
    from pyspark.sql import Window
    # one group holds ~a third of the rows, one is NULL
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string")))
        .alias("g"), ((F.col("id") * 7919) % 3001).alias("o"), "id")
    got = I.row_number_in_group(df, ["g"], ["o", "id"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    assert sorted(map(tuple, got.select("id", "g", "rn").collect())) == \
        sorted(map(tuple, want.select("id", "g", "rn").collect()))


def test_hot_group_is_split_into_slices(spark):
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("g"), "id")
    sl = I.with_key_slices(df, ["g", "id"], n=8)
    hot_slices = sl.where("g = 'hot'").select("_slice").distinct().count()
    assert hot_slices >= 2
    # the slice is a pure function of the data: two evaluations agree
    a = sorted(map(tuple, sl.select("id", "_slice").collect()))
    b = sorted(map(tuple, I.with_key_slices(df, ["g", "id"], n=8).select("id", "_slice").collect()))
    assert a == b


def test_last_seen_null_name_drops_indicator_and_observations(spark):
    rows = [("C1", "named", 1), ("C1", None, 2), ("C2", None, 3), ("C2", "later", 4), ("C3", "x", 5)]
    df = spark.createDataFrame(rows, "indicator_code string, indicator_name string, ord int")
    dim = I.dedupe_last_wins(df, "indicator_code", "ord", ["indicator_name"], required=["indicator_name"])
    assert sorted((r.indicator_code, r.indicator_name) for r in dim.collect()) == [("C2", "later"), ("C3", "x")]
    assert [r.indicator_code for r in I.dedupe_rejects(df, "indicator_code", "ord", ["indicator_name"]).collect()] == ["C1"]
    keyed = I.sorted_surrogate_key(dim, "first_ord", "indicator_id")
    long = spark.createDataFrame([("A", "C1", 2000, 1.0), ("A", "C2", 2000, 2.0)],
                                 "country_name string, indicator_code string, year int, value double")
    c = spark.createDataFrame([(1, "A")], "country_id long, country_name string")
    facts = I.lookup_facts(long, c, keyed)
    assert [r.value for r in facts.collect()] == [2.0]


def test_row_number_builds_without_running_a_job_and_takes_empty_input(spark):
    df = spark.createDataFrame([], "g string, o long")
    assert I.row_number_in_group(df, ["g"], ["o"], "rn").collect() == []
    same_key = spark.range(0, 100).select(F.lit("g").alias("g"), F.lit(1).alias("o"), "id")
    got = I.row_number_in_group(same_key, ["g"], ["o"], "rn").collect()
    assert sorted(r.rn for r in got) == list(range(1, 101))
