from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from skylag.operators import drift, explain, metrics, stats
from skylag.operators.cumulative import cumulative_counts
from skylag.operators.lineage import lineage


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    score = np.round(rng.random(20_000) ** 2, 3)
    label = (rng.random(20_000) < score).astype(int)
    return spark.createDataFrame(
        [(float(s), int(y)) for s, y in zip(score, label, strict=True)], "delay_probability double, is_delayed int"
    )


def test_auc_against_pair_counting_and_mllib(scored):
    pdf = scored.toPandas()
    pos, neg = (pdf.delay_probability[pdf.is_delayed == k].to_numpy() for k in (1, 0))
    neg.sort()
    wins = np.searchsorted(neg, pos, "left").sum() + 0.5 * (
        np.searchsorted(neg, pos, "right") - np.searchsorted(neg, pos, "left")
    ).sum()
    ours = metrics.auc_roc(scored).first()["value"]
    assert ours == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="delay_probability", labelCol="is_delayed", numBins=0
    )
    assert ours == pytest.approx(evaluator.evaluate(scored), abs=1e-9)


def test_average_precision_against_brute_force(scored):
    pdf = scored.toPandas().sort_values("delay_probability", ascending=False)
    by_score = pdf.groupby("delay_probability").is_delayed.agg(["sum", "count"]).sort_index(ascending=False)
    precision = by_score["sum"].cumsum() / by_score["count"].cumsum()
    expected = (precision * by_score["sum"]).sum() / by_score["sum"].sum()
    row = metrics.ranking_metrics(scored).first()
    assert row["average_precision"] == pytest.approx(expected, abs=1e-12)
    assert row["brier_score"] == pytest.approx(((pdf.delay_probability - pdf.is_delayed) ** 2).mean(), abs=1e-12)
    assert metrics.brier_score(scored).first()["value"] == pytest.approx(row["brier_score"], abs=1e-12)


def test_one_class_gives_no_auc(scored):
    row = metrics.ranking_metrics(scored.where("is_delayed = 1")).first()
    assert row["auc_roc"] is None and row["average_precision"] == 1.0


def test_cumulative_counts_over_many_slices(spark):
    """Slices cut through a key that holds most values; AQE would merge them on small data."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        counts = spark.range(5_000).selectExpr(
            "CASE WHEN id % 10 = 0 THEN 'small' ELSE 'big' END AS k", "cast((id * 7919) % 5000 AS double) AS v", "id % 4 AS n"
        )
        table = cumulative_counts(counts, ["k"], "v", ["n"])
        pdf = table.toPandas().sort_values(["k", "v"])
        assert len(pdf) == 5_000
        expected = pdf.groupby("k").n.cumsum()
        assert (pdf.cum_n == expected).all()
        assert (pdf.total_n == pdf.groupby("k").n.transform("sum")).all()
    finally:
        spark.conf.set(setting, before)


def _ks(a, b):
    a, b = np.sort(a), np.sort(b)
    grid = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=3_000), rng.normal(0.1, 1.1, size=2_000)
    ref = spark.createDataFrame([(float(x), 1) for x in a], "x double, n int")
    cur = spark.createDataFrame([(float(x), 1) for x in b] + [(None, 1)], "x double, n int")
    rows = {r["feature"]: r for r in drift.ks_drift(ref, cur).collect()}
    assert rows["x"]["statistic"] == pytest.approx(_ks(a, b), abs=1e-6)
    assert (rows["x"]["n_ref"], rows["x"]["n_cur"]) == (3_000, 2_000)
    assert rows["n"]["statistic"] == 0.0 and rows["n"]["p_value"] == 1.0 and not rows["n"]["drifted"]


def test_few_samples_are_not_tested(spark):
    ref = spark.range(100).selectExpr("cast(id AS double) AS x")
    assert drift.ks_drift(ref, ref.where("x < 29")).isEmpty()
    assert drift.ks_drift(ref, ref.where("x < 30")).count() == 1


def test_monitor_first_run_then_same_then_shifted(spark, tmp_path):
    base = spark.range(2_000).selectExpr("cast(id AS double) AS x", "id / 2000 AS delay_probability", "'t' AS text")
    monitor = drift.DriftMonitor(spark, str(tmp_path / "m"))
    tests, summary = monitor.run(base)
    assert tests.isEmpty() and summary.first()["drift_detected"] is False
    tests, summary = monitor.run(base)
    assert tests.count() == 2 and summary.first()["n_drifted"] == 0
    assert summary.first()["score_shift"] == 0.0
    shifted = base.withColumn("delay_probability", F.col("delay_probability") + 0.3).withColumn("x", F.lit(None).cast("double"))
    _, summary = monitor.run(shifted)
    row = summary.first()
    assert row["drift_detected"] and row["drifted_features"] == ["delay_probability"]
    assert row["score_shift"] == 0.3 and row["missing_ratio"] == 0.3333 and row["n_numeric_tested"] == 2
    reports = spark.read.json(str(tmp_path / "m" / "reports"))
    assert reports.count() == 2


def test_halves(spark):
    df = spark.range(101).selectExpr("id AS k", "cast(id AS double) AS x")
    early, late = drift.split_halves(df, F.col("k"))
    assert (early.count(), late.count()) == (50, 51)
    keyless = df.withColumn("k", F.when(F.col("k") > 90, F.col("k")))
    early, late = drift.split_halves(keyless, F.col("k"))
    assert (early.count(), late.count()) == (91, 10)


def test_histogram_is_monotone_and_complete(scored):
    rows = stats.score_histogram(scored).collect()
    counts = [r["n"] for r in rows]
    assert counts == sorted(counts) and counts[-1] == 20_000 and rows[-1]["le"] == "+Inf"


def test_top_k_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("f", 0.5, -0.5, 0.1, -0.9)], "flight_id string, b double, a double, c double, d double")
    top = explain.top_attributions(df, ["b", "a", "c", "d"], 3).first()["attributions"]
    assert list(top.items()) == [("d", -0.9), ("a", -0.5), ("b", 0.5)]


def test_lineage_with_cycle_and_depth(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("z", "a")], "src string, dst string"
    )
    rows = {(r["node"], r["direction"]): r["depth"] for r in lineage(edges, "a", 2).collect()}
    assert rows == {
        ("b", "downstream"): 1, ("c", "downstream"): 2,
        ("c", "upstream"): 1, ("z", "upstream"): 1, ("b", "upstream"): 2,
    }
    assert lineage(edges, "nobody", 3).isEmpty()
