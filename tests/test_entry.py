"""The driver contract of __spark_entry__.py."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_returns_rows_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert E.entry(spark).schema == df.schema


def test_every_oracle_key_has_a_plan():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    plain = {k for k in q if k != "pipeline" and not k.startswith("op")}
    assert plain - set(o) == set()
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
