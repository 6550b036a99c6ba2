"""Every registered query of the base engine against its SQL."""

import pytest
from compare import same

from antipode.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    same(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLES[name])


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"spacesaving_topk", "train_epoch", "train_resume"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
