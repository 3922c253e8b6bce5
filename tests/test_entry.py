"""The driver's contract on the smallest tables."""

from __future__ import annotations

import __spark_entry__
from workmap.plans import QUERIES, SQL


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["path_prefix_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "GreaterThan(url" in plan and "LessThan(url" in plan
    assert "html" not in plan.split("ReadSchema")[1].split("\n")[0]
