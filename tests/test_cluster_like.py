"""The plans of a large table: no side is small enough to broadcast, slices stay apart."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF

from skylag.plans.catalog import QUERIES
from skylag.plans.oracles import ORACLES

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "13",
}


@pytest.fixture(scope="module")
def large(spark):
    before = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name",
    [
        "carrier_features", "carrier_history", "route_history", "carrier_risk_by_hour_weather", "flight_carrier_risk",
        "duplicate_rows", "data_quality", "auc_roc", "average_precision", "ks_drift", "drift_halves", "drift_summary",
        "upsert_flights", "delete_flights", "lineage",
    ],
)
def test_same_result_without_broadcasts(large, name):
    assert differences(QUERIES[name](large, SF), connect(SF), ORACLES[name]) == []


def test_hot_carrier_lookup_falls_back_to_a_shuffle(large):
    from skylag.plans import views
    from skylag.operators.features import FlightFeatures

    flights = views.flights(large, SF)
    plan = FlightFeatures(holiday="explicit").fit(flights).transform(flights)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from skylag.sources.scratch import scratch_root

    unset = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_root(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))


def test_clearing_leaves_no_intermediate_table(spark, monkeypatch, tmp_path):
    from skylag.sources.scratch import clear, materialize

    monkeypatch.setattr("skylag.sources.scratch.scratch_root", lambda session: str(tmp_path))
    assert materialize(spark.range(3), "three").count() == 3
    assert list(tmp_path.iterdir())
    clear(spark)
    assert not list(tmp_path.iterdir())
