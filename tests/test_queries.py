"""Every query that has SQL, on whole small tables."""

import re

import pytest
from oracle import differences

from inkprint.plans.registry import oracle_sql, queries

SQL = oracle_sql()
# features_all computes the single-feature queries' columns in one go.
ONE_FEATURE = re.compile(r"f(0[1-9]|[123]\d)_")


@pytest.mark.parametrize("name", [n for n in SQL if not ONE_FEATURE.match(n)])
def test_matches_sql(spark, small, duck_con, name):
    assert differences(queries()[name](spark, small), duck_con, SQL[name]) is None


def test_every_feature_fires(spark, small):
    """No stylometric column is constant on the text the queries use."""
    from pyspark.sql import functions as F

    d = queries()["features_all"](spark, small).drop("doc_id")
    row = d.agg(*[F.count_distinct(c).alias(c) for c in d.columns]).first().asDict()
    assert [c for c, n in row.items() if n < 2] == []


def test_single_features_have_sql():
    names = [n for n in queries() if ONE_FEATURE.match(n)]
    assert len(names) == 39 and all(n in SQL for n in names)
