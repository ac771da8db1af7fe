"""Every registered query against its SQL, on the tables the driver uses."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as contract
from skylag.plans.catalog import QUERIES
from skylag.plans.oracles import ORACLES

# Named in the blueprint as not expressible in SQL: fitted models and callback counts.
ROWS_ONLY = {
    "ensemble_score",
    "calibrated_score",
    "score_batch",
    "evaluate",
    "occlusion_attributions",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
