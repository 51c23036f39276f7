"""Bucketed facts: the fact side of the star join is not shuffled, a hot key lies in several buckets."""

from pyspark.sql import functions as F

from fiscus.sources.layout import write_bucketed


def test_bucketed_star_join(spark):
    facts = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 97 + 2).cast("long").alias("k"),
        F.col("id").alias("v"))
    dim = spark.range(0, 60).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    stored = write_bucketed(facts, "k", 8)
    parts = {r.k: r.parts for r in stored.hot.collect()}
    assert parts == {1: 3} and {r._part for r in stored.facts.where("k = 1").select("_part").distinct().collect()} == {0, 1, 2}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.join(dim)
        plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
        fact_side = plan[plan.index("SortMergeJoin"):].split("Scan parquet spark_catalog")[0]
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, facts.join(dim, "k").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and "Exchange" not in fact_side
    assert stored.facts.where("k is null").count() == facts.where("k is null").count()
    assert stored.facts.where("k = 1").select(F.input_file_name()).distinct().count() > 1
    assert write_bucketed(facts.limit(0), "k", 4).join(dim).collect() == []
