"""Streaming = batch for the incremental ingest (R1) and running totals (R2)."""

import pytest

from fiscus.operators import evaluate as E
from fiscus.operators import ingest as I
from fiscus.sources import files as S
from fiscus.streaming import ingest_stream as R


IDS = ["COUNTRY", "SECTOR", "SERIES_CODE"]
SCHEMA = S.wide_csv_schema(IDS, range(2000, 2002))


def _files(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = "COUNTRY,SECTOR,SERIES_CODE,2000,2001\n"
    (src / "a.csv").write_text(head + "Chile,Local,R,1.0,2.0\nPeru,,R,,3.0\n")
    (src / "b.csv").write_text(head + "Peru,State,E,4.0,\nAruba,Local,E,5.0,6.0\n")
    return src


def _ids(spark, root):
    return {n: sorted(tuple(r) for r in R.dimension(spark, f"{root}/dim", n, i, c).select(i, c).collect())
            for n, i, c in R.DIMENSIONS.values()}


def _named(spark, root):
    facts = spark.read.parquet(f"{root}/facts")
    for n, i, c in R.DIMENSIONS.values():
        facts = facts.join(R.dimension(spark, f"{root}/dim", n, i, c).drop("batch"), i, "left")
    rows = facts.select("country_name", "sector_name", "indicator_code", "year", "value").collect()
    return sorted(map(tuple, rows), key=repr)


def test_file_ingest_stream_equals_batch(spark, tmp_path):
    src = _files(tmp_path)
    want = sorted(map(tuple, I.unpivot_years(S.read_wide_csv(spark, str(src), SCHEMA), IDS).collect()), key=repr)
    for n in (1, 2):
        root = str(tmp_path / f"out{n}")
        R.start_file_ingest(spark, str(src), f"{root}/dim", f"{root}/facts", IDS, ["2000", "2001"],
                            name=f"t_ingest{n}", files_per_batch=n).awaitTermination(120)
        assert _named(spark, root) == want
        for rows in _ids(spark, root).values():  # each name once, ids dense
            assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
            assert len({r[1] for r in rows}) == len(rows)


def test_repeated_and_half_done_batches_change_nothing(spark, tmp_path):
    src, root = _files(tmp_path), str(tmp_path / "out")
    a, b = (S.read_wide_csv(spark, str(src / f), SCHEMA) for f in ("a.csv", "b.csv"))
    R.create_dimensions(spark, f"{root}/dim", IDS)
    run = R.ingest_batch(f"{root}/dim", f"{root}/facts", IDS, ["2000", "2001"])
    run(a, 0)
    run(a, 0)
    assert len(_ids(spark, root)["countries"]) == 2
    # batch 1 fails after its dimensions: its facts cannot be written
    blocked = tmp_path / "blocked"
    blocked.write_text("a file, not a folder")
    with pytest.raises(Exception):
        R.ingest_batch(f"{root}/dim", f"{blocked}/facts", IDS, ["2000", "2001"])(b, 1)
    ids = _ids(spark, root)
    run(b, 1)
    run(b, 1)
    assert _ids(spark, root) == ids
    want = sorted(map(tuple, I.unpivot_years(a.union(b), IDS).collect()), key=repr)
    assert _named(spark, root) == want


def test_running_usage_equals_batch(spark, tmp_path):
    from conftest import SF_SMALL
    from fiscus.sources.tables import Tables
    usage = E.usage_log(Tables(spark, SF_SMALL))
    usage.repartition(3).write.parquet(str(tmp_path / "usage"))
    prices = E.price_table(spark)
    q = R.start_running_usage(spark, str(tmp_path / "usage"), prices, str(tmp_path / "totals"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in R.latest_usage(spark, str(tmp_path / "totals")).collect())
    want = sorted(tuple(r) for r in E.cost_rollup(usage, prices).collect())
    assert got == want
