"""Prefix scan against Spark's own window, on a hot series, ties, nulls and any number of slices."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fiscus.operators.series import prefix_scan


def test_prefix_scan_is_the_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 300), rng.choice([None, 1.0, 2.5, 7.25]), n) for n in range(900)]
    rows += [("nulls", n, None, n) for n in range(5)] + [("one", 1, 4.0, 1)]
    df = spark.createDataFrame(rows, "s string, o int, v double, extra int").repartition(6)
    w = Window.partitionBy("s")
    want = (df.withColumn("previous_value", F.lag("v").over(w.orderBy("o", "v")))
            .withColumn("running_total", F.sum("v").over(w.orderBy("o"))).drop("extra"))
    for n in (1, 2, 7, 40):
        got = prefix_scan(df, ["s"], ["o"], "v", slices=n)
        assert got.columns == ["s", "o", "v", "extra", "previous_value", "running_total"]
        assert sorted(map(str, got.drop("extra").collect())) == sorted(map(str, want.collect()))
    assert prefix_scan(df.limit(0), ["s"], ["o"], "v").collect() == []


def test_a_hot_series_is_cut(spark):
    df = spark.range(4000).select(F.lit(1).alias("s"), F.col("id").alias("o"), (F.col("id") * 1.0).alias("v"))
    from fiscus.operators.ingest import with_key_slices
    sizes = [r["count"] for r in with_key_slices(df, ["s", "o"], 8).groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200
    last = prefix_scan(df, ["s"], ["o"], "v", slices=8).where("o = 3999").first()
    assert (last.previous_value, last.running_total) == (3998.0, 3999 * 4000 / 2)
