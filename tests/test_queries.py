import pytest

import __spark_entry__
from millrace.plans import registry

SMALL = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"base_set_except", "base_set_except_all", "cat_name_clashes", "base_join_range", "base_join_left_anti", "cat_patterns_in_three_domains"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, compare, name):
    got = compare(registry.QUERIES[name](spark, SMALL), registry.SQL[name], SMALL)
    assert len(got) or name in MAY_BE_EMPTY


def test_sketches_are_near(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    exact = lines.select("l_partkey").distinct().count()
    r = registry.QUERIES["base_approximate"](spark, SMALL).first()
    assert abs(r["parts"] - exact) <= 0.15 * exact and abs(r["hll"] - exact) <= 0.1 * exact


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
