"""Property checks: result equality is reflexive and symmetric; the
conditional pivot matches a plain-Python sum."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fiscus.operators.evaluate import result_equality
from fiscus.plans import analytics as A

rows = st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 2)), min_size=0, max_size=8)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _results(spark, gold, pred):
    data = [("q", i + 1, "gold", a, b) for i, (a, b) in enumerate(gold)] + \
           [("q", i + 1, "pred", a, b) for i, (a, b) in enumerate(pred)]
    df = spark.createDataFrame(data or [("q", 0, "none", 0, 0)],
                               "query_id string, pos int, side string, a int, b int")
    return df.withColumn("row", F.struct("a", "b"))


@SETTINGS
@given(gold=rows)
def test_equality_reflexive(spark, gold):
    if not gold:
        return
    r = result_equality(_results(spark, gold, gold)).collect()[0]
    assert r.ordered_equal and r.multiset_equal


@SETTINGS
@given(gold=rows, pred=rows)
def test_equality_symmetric(spark, gold, pred):
    if not gold or not pred:
        return
    ab = result_equality(_results(spark, gold, pred)).collect()[0]
    ba = result_equality(_results(spark, pred, gold)).collect()[0]
    assert (ab.ordered_equal, ab.multiset_equal) == (ba.ordered_equal, ba.multiset_equal)
    assert ab.multiset_equal == (sorted(gold) == sorted(pred))
    assert ab.ordered_equal == (gold == pred)


@SETTINGS
@given(data=st.lists(st.tuples(st.sampled_from(["x", "y"]), st.sampled_from(["A", "B", "C"]),
                               st.integers(0, 10000)), min_size=1, max_size=10))
def test_conditional_pivot_matches_python(spark, data):
    df = spark.createDataFrame([(k, s, v / 100) for k, s, v in data], "k string, s string, value double")
    # double sums: equal but for the last bits
    got = {r.k: (round(r.a, 6), round(r.b, 6)) for r in A.conditional_pivot(df, ["k"], F.col("s"), {"a": "A", "b": "B"}).collect()}
    want = {}
    for k, s, v in data:
        a, b = want.get(k, (0, 0))
        want[k] = (a + (v if s == "A" else 0), b + (v if s == "B" else 0))
    assert got == {k: (a / 100, b / 100) for k, (a, b) in want.items()}


def test_equality_with_tolerance(spark):
    df = spark.createDataFrame(
        [("q", 1, "gold", 1, 1.0), ("q", 1, "pred", 1, 1.0000001), ("q", 2, "gold", 2, 2.0), ("q", 2, "pred", 2, 2.0)],
        "query_id string, pos int, side string, a int, b double").withColumn("row", F.struct("a", "b"))
    exact = result_equality(df).collect()[0]
    loose = result_equality(df, tolerance=1e-6).collect()[0]
    assert not exact.ordered_equal and loose.ordered_equal
