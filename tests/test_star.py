from conftest import SF_SMALL
from fiscus.plans.star import STAR_CATALOG, Star


def test_catalog_matches_star_schemas(spark):
    s = Star(spark, SF_SMALL)
    frames = {"countries": s.countries(), "time_periods": s.time_periods(), "sectors": s.sectors(),
              "indicators": s.indicators(), "gfs_observations": s.gfs(), "gem_observations": s.gem()}
    got = [(t, f.name, f.dataType.simpleString(), i + 1)
           for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    assert sorted(got) == sorted(STAR_CATALOG)


def test_sector_ids_follow_sorted_names(spark):
    rows = Star(spark, SF_SMALL).sectors().orderBy("sector_id").collect()
    names = [r.sector_name for r in rows]
    assert names == sorted(names)
    assert [r.sector_id for r in rows] == list(range(1, len(rows) + 1))


def test_fact_filters_reach_the_scan(spark):
    df = Star(spark, SF_SMALL).gfs().where("transformation = 'N'").select("value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,N)" in plan


def test_materialized_star_gives_same_results(spark, tmp_path):
    from fiscus.plans import registry
    from fiscus.plans.star import STAR_DIR_CONF
    registry.load_all()
    Star(spark, SF_SMALL).materialize(str(tmp_path / "star"))
    keys = ["proj_star_series", "correlation", "topn_count", "coverage_multi_distinct", "dq_orphans"]
    base = {k: sorted(map(tuple, registry.QUERIES[k](spark, SF_SMALL).collect()), key=repr) for k in keys}
    spark.conf.set(STAR_DIR_CONF, str(tmp_path / "star"))
    try:
        for k in keys:
            got = sorted(map(tuple, registry.QUERIES[k](spark, SF_SMALL).collect()), key=repr)
            assert got == base[k], k
        plan = Star(spark, SF_SMALL).gfs().where("year = 1998")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan
    finally:
        spark.conf.unset(STAR_DIR_CONF)


def test_a_missing_table_is_reported(spark, tmp_path):
    import os
    from fiscus.operators.quality import table_presence
    for t in ("nation", "region", "orders", "part", "lineitem", "supplier"):  # no customer
        os.symlink(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    got = {r.table_name: r.present for r in table_presence(Star(spark, str(tmp_path))).collect()}
    assert [t for t, there in got.items() if not there] and len(got) == 6
    assert {t for t, there in got.items() if not there} == {"sectors", "gfs_observations"}


def test_a_star_of_other_tables_is_not_read(spark, tmp_path):
    import pytest
    from fiscus.plans.star import STAR_DIR_CONF
    Star(spark, SF_SMALL).materialize(str(tmp_path / "star"))
    spark.conf.set(STAR_DIR_CONF, str(tmp_path / "star"))
    try:
        assert Star(spark, SF_SMALL + "/").gem().count() > 0
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            Star(spark, "/root/testdata/sf0.01").gem().count()
    finally:
        spark.conf.unset(STAR_DIR_CONF)


def test_sums_keep_all_digits(spark):
    from pyspark.sql import functions as F
    from fiscus.plans import analytics as A
    df = spark.range(1000).select(F.lit("a").alias("k"), F.lit(0.004).alias("value"))
    assert round(A.one_per_period(df, ["k"]).first()["value"], 9) == 4.0
    assert round(A.conditional_pivot(df, ["k"], F.col("k"), {"a": "a"}).first()["a"], 9) == 4.0
    big = spark.createDataFrame([("a", 1, 3e16), ("a", 2, 1e16)], "k string, t int, value double")
    assert A.one_per_period(big, ["k"]).first()["value"] == 4e16
    assert A.running_total(big, ["k"], "t", "value").agg(F.max("running_total")).first()[0] == 4e16
