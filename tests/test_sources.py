"""File sources and sinks round-trips on hand-made files."""

import json

from fiscus.operators import ingest as I
from fiscus.sources import files as S


def test_wide_csv_then_unpivot(spark, tmp_path):
    p = tmp_path / "gfs.csv"
    p.write_text("COUNTRY,SECTOR,SERIES_CODE,1972,1973\n"
                 "Chile,General government,R1,1.5,\n"
                 "Peru,,R1,,0\n")
    schema = S.wide_csv_schema(["COUNTRY", "SECTOR", "SERIES_CODE"], range(1972, 1974))
    wide = S.read_wide_csv(spark, str(p), schema)
    long = I.unpivot_years(wide, ["COUNTRY", "SECTOR", "SERIES_CODE"])
    assert sorted(map(tuple, long.collect()), key=repr) == sorted(
        [("Chile", "General government", "R1", 1972, 1.5), ("Peru", None, "R1", 1973, 0.0)], key=repr)


def test_series_matrices_per_file_headers(spark, tmp_path):
    (tmp_path / "GDP at market prices, current US$, millions, seas. adj..csv").write_text(
        'year,"Korea, Rep.",Chile\n2001,1.0,2.0\n2002,,x\n')
    (tmp_path / "Terms of Trade.csv").write_text("year,Peru\n1971,5\n2003,6\n")
    long = S.read_series_matrices(spark, str(tmp_path) + "/*.csv")
    rows = sorted((r.file_name[:3], r.year_raw, r.country, r.value_raw) for r in long.collect())
    assert rows == sorted([("GDP", "2001", "Korea, Rep.", "1.0"), ("GDP", "2001", "Chile", "2.0"),
                           ("GDP", "2002", "Korea, Rep.", None), ("GDP", "2002", "Chile", "x"),
                           ("Ter", "1971", "Peru", "5"), ("Ter", "2003", "Peru", "6")], key=repr)
    typed = I.safe_cast_reject(long, "year_raw", "value_raw")
    reasons = sorted((r.country, r.year_raw, r.reject_reason) for r in typed.collect()
                     if r.reject_reason is not None)
    assert reasons == [("Chile", "2002", "bad_value"), ("Korea, Rep.", "2002", "empty_value"),
                       ("Peru", "1971", "year_out_of_range")]


def test_json_array_and_jsonl(spark, tmp_path):
    qs = [{"id": 1, "question": "q1", "ground_truth_sql": "SELECT 1", "difficulty": "simple", "category": "c"}]
    (tmp_path / "q.json").write_text(json.dumps(qs, indent=2))
    assert S.read_json_array(spark, str(tmp_path / "q.json")).collect()[0].ground_truth_sql == "SELECT 1"
    msgs = {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"},
                         {"role": "assistant", "content": "a"}]}
    (tmp_path / "t.jsonl").write_text(json.dumps(msgs) + "\n\n{not json\n")
    df = S.read_jsonl(spark, str(tmp_path / "t.jsonl")).cache()
    assert df.count() == 2
    assert df.where("_corrupt_record IS NOT NULL").count() == 1


def test_augmented_partitioned_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "synonym"), (2, "b", "hard_example")],
                               "id long, question string, augmentation_type string")
    S.write_augmented(df, str(tmp_path / "aug"))
    back = S.load_augmented(spark, str(tmp_path / "aug"), "synonym")
    assert [r.id for r in back.collect()] == [1]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_whole_text_and_report(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# 1. Reminder of mistake\nA\n# 2. Reminder of mistake\nB\n")
    assert S.read_whole_text(spark, str(tmp_path / "g.txt")).collect()[0].value.count("Reminder") == 2
    rep = spark.createDataFrame([("m1", 50.0)], "model string, accuracy double")
    S.write_report(rep, str(tmp_path / "rep"), ["model", "accuracy"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "rep" / "markdown")).collect()]
    assert lines == ["| m1 | 50.0 |"]


def test_append_facts_partitioned(spark, tmp_path):
    f = spark.createDataFrame([(1, 2000, 1.0), (2, 2001, 2.0)], "country_id long, year int, value double")
    S.append_facts(f, str(tmp_path / "facts"))
    S.append_facts(f, str(tmp_path / "facts"))
    back = spark.read.parquet(str(tmp_path / "facts")).where("year = 2000")
    assert back.count() == 2
