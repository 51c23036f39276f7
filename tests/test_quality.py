"""The quality report on hand-made tables: orphans, NULL keys, duplicates, empty tables."""

from __future__ import annotations

from fiscus.operators import quality
from fiscus.plans.star import Star

GFS = "country_id long, year int, sector_id long, indicator_id long, value double"
GEM = "country_id long, year int, indicator_id long, value double"


def tables(spark, gfs, gem, parents):
    dims = {"countries": "country_id", "sectors": "sector_id", "indicators": "indicator_id", "time_periods": "year"}
    out = {t: spark.createDataFrame([(x,) for x in parents], f"{c} long") for t, c in dims.items()}
    return out | {"gfs_observations": spark.createDataFrame(gfs, GFS), "gem_observations": spark.createDataFrame(gem, GEM)}


def values(spark, monkeypatch, made):
    monkeypatch.setattr(quality, "star_tables", lambda S: made)
    rows = quality.report(Star(spark, "/root/testdata/sf0.001")).collect()
    assert len(rows) == 23
    return {(r.check, r.subject): (r.value, r.severity, r.passed) for r in rows if r.check != "table_present"}


def test_report_counts(spark, monkeypatch):
    gfs = [(1, 2, None, 1, 1.0), (1, 2, None, 1, None), (9, 2, 1, 1, 2.0), (9, 2, 2, 1, 2.0), (None, 8, 1, 1, 3.0)]
    got = values(spark, monkeypatch, tables(spark, gfs, [(1, 1, 7, None)], [1, 2, 2]))
    assert got["row_count", "gfs_observations"] == (5, "error", True) and got["row_count", "sectors"] == (3, "error", True)
    assert got["orphans", "gfs.country_id"] == (2, "error", False) and got["orphans", "gfs.sector_id"] == (0, "error", True)
    assert got["orphans", "gfs.year"] == (1, "error", False) and got["orphans", "gem.indicator_id"] == (1, "error", False)
    assert got["nulls", "gfs_observations.value"] == (1, "warning", False)
    assert got["duplicate_groups", "gfs_observations"] == (1, "warning", False)
    assert got["duplicate_groups", "gem_observations"] == (0, "warning", True)


def test_report_of_empty_tables(spark, monkeypatch):
    got = values(spark, monkeypatch, tables(spark, [], [], []))
    assert all(v == (0, "error", False) for (check, _), v in got.items() if check == "row_count")
    assert all(v[0] == 0 and v[2] for (check, _), v in got.items() if check != "row_count")
