"""Every registered query of the library itself against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from edgewright.plans import catalogue
from tests.oracle import assert_equal

SLOW = ("negatives_", "negative_checks_N1", "negative_checks_N3", "negative_checks_N5", "negative_checks_N6", "negative_checks_N7", "negative_checks_N2_exact", "model_rf", "model_gbt", "model_mlp", "component_bootstrap", "seed_sweep", "dataset_builders", "negative_designs", "nested_features", "cross_validation", "ctd_transition", "ctd_distribution")


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not n.startswith(SLOW)])
def test_query(spark, data, name):
    rows = catalogue.QUERIES[name](spark, data).toPandas()
    if name in catalogue.ORACLE_SQL:
        assert_equal(rows, catalogue.ORACLE_SQL[name], data)
    else:
        assert len(rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
