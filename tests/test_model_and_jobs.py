from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from skylag.functions import flight
from skylag.operators import explain, model, trees
from skylag.plans import jobs, views
from skylag.sources import branches
from skylag.sources.scratch import materialize


@pytest.fixture(scope="module")
def flights(spark):
    return materialize(views.flights(spark, SF_SMALL).drop("delay_probability").dropDuplicates(["flight_id"]), "flights")


@pytest.fixture(scope="module")
def trained(flights, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    fitted, metrics = jobs.train(flights, path, model.EnsembleParams.small(), validation_fraction=0.2)
    return path, fitted, metrics


def test_metrics_of_both_splits(trained):
    rows = {(r["split"], r["metric"]): r["value"] for r in trained[2].collect()}
    assert {s for s, _ in rows} == {"train", "val"}
    for split in ("train", "val"):
        assert 0.4 < rows[(split, "auc_roc")] <= 1 and 0 <= rows[(split, "brier_score")] < 0.25
    assert rows[("train", "auc_roc")] > 0.5


def test_no_label_source_is_a_feature(trained):
    assert not {"dep_delay_minutes", "is_delayed", "delay_probability"} & set(trained[1].ensemble.features)


def test_saved_model_scores_alike(spark, trained, flights):
    path, fitted, _ = trained
    loaded = jobs.Fitted.load(spark, path)
    assert loaded.ensemble.features == fitted.ensemble.features
    assert loaded.ensemble.settings == fitted.ensemble.settings
    a, _ = jobs.score(flights, fitted)
    b, _ = jobs.score(flights, loaded)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() > 4_000


def test_scores_are_probabilities_with_matching_tiers(trained, flights):
    scored, rejected = jobs.score(flights, trained[1])
    row = scored.agg(
        F.min("delay_probability"), F.max("delay_probability"),
        F.count_if(F.col("delay_tier") != flight.delay_tier(F.col("delay_probability"), (0.75, 0.50, 0.25))),
        F.count_if(F.col("carrier_risk_score").isNull()),
    ).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] == row[3] == 0
    assert scored.count() + rejected.count() == flights.count()


def test_calibration_is_monotone_in_one_fold(trained, spark):
    votes = spark.range(101).select((F.col("id") / 100).alias("_vote_0"))
    out = trained[1].ensemble.folds[0].isotonic.transform(votes).orderBy("_vote_0").collect()
    values = [r["_calibrated_0"] for r in out]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def test_occlusion_adds_up_to_the_score_change(trained, flights):
    fitted = trained[1]
    few = materialize(flights.orderBy("flight_id").limit(40), "few")
    matrix = fitted.features.transform(few)
    values = explain.occlusion(fitted.ensemble, matrix)
    assert values.count() == 40 * len(fitted.ensemble.features)
    name = "prior_leg_delay_minutes"
    mean = fitted.ensemble.prepare.stages[1].mean[fitted.ensemble.features.index(name)]
    plain = fitted.ensemble.transform(matrix).select("flight_id", F.col("delay_probability").alias("p"))
    changed = fitted.ensemble.transform(matrix.withColumn(name, F.lit(float(mean)))).select("flight_id", "delay_probability")
    gap = (
        values.where(F.col("feature") == name)
        .join(plain, "flight_id")
        .join(changed, "flight_id")
        .agg(F.max(F.abs(F.col("value") - (F.col("p") - F.col("delay_probability")))))
    )
    assert gap.first()[0] < 1.5e-6
    assert 0 <= explain.base_value(fitted.ensemble, few).first()[0] <= 1


def test_scores_with_explanations(trained, flights):
    few = materialize(flights.orderBy("flight_id").limit(40), "few")
    plain, _ = jobs.score(few, trained[1])
    explained, _ = jobs.score(few, trained[1], attributions=3)
    assert plain.exceptAll(explained.drop("attributions")).isEmpty() and explained.count() == plain.count()
    assert {r[0] for r in explained.select(F.size("attributions")).collect()} == {3}


def test_standardize_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(map(tuple, model.standardize(df, ["a", "b"]).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def test_folds_hold_each_label_alike(flights):
    rows = flights.selectExpr("flight_id", "coalesce(dep_delay_minutes >= 15, false) AS late").withColumn("late", F.col("late").cast("int"))
    folds = model.with_folds(rows, "late", [], 42)
    assert set(folds.columns) == {"flight_id", "late", "_fold"}
    sizes: dict[int, list[int]] = {}
    for r in folds.groupBy("late", "_fold").count().collect():
        sizes.setdefault(r["late"], []).append(r["count"])
    assert all(len(v) == 3 and max(v) - min(v) <= 1 for v in sizes.values()) and sum(map(sum, sizes.values())) == rows.count()
    again = model.with_folds(rows.repartition(3), "late", [], 42)
    assert folds.exceptAll(again.select(folds.columns)).isEmpty()
    same = rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n")
    assert sorted(r["count"] for r in model.with_folds(same, "late", [], 42).groupBy("_fold").count().collect()) == [33, 33, 34]


def test_boosting_ends_early(flights):
    matrix = jobs.fit(flights, model.EnsembleParams.small())[1]
    watched = model.BoostedParams(max_iter=30, max_depth=2, step_size=0.5, validation_tol=0.05, validation_share=0.3)
    params = model.EnsembleParams(watched, watched, model.ForestParams(2, 2))
    fitted = model.DelayEnsemble(["distance_miles", "prior_leg_delay_minutes"], settings=params).fit(matrix)
    used = {(r["fold"], r["learner"]): r["trees"] for r in fitted.rounds().collect()}
    assert len(used) == 9 and all(1 <= n < 30 for (_, name), n in used.items() if name != "c")


def test_path_attributions_add_up(trained, flights):
    fitted = trained[1]
    few = materialize(flights.orderBy("flight_id").limit(200), "few-paths")
    rows = explain.path_contributions(fitted.ensemble, fitted.features.transform(few)).collect()
    assert len(rows) == 200 * 9 and any(v for r in rows for v in r["contributions"].values())
    assert max(abs(r["base_value"] + sum(r["contributions"].values()) - r["margin"]) for r in rows) < 1e-12
    votes = explain.vote_entries(fitted.ensemble, fitted.features.transform(few), ["flight_id"]).collect()
    assert max(abs(r["base_vote"] + sum(e["value"] for e in r["entries"]) - r["ensemble_vote"]) for r in votes) < 2e-5


def test_training_needs_both_classes(flights):
    with pytest.raises(ValueError, match="labels"):
        jobs.fit(flights.where("dep_delay_minutes >= 15"), model.EnsembleParams.small())


def test_retrain_publishes_model_and_metrics(spark, flights, tmp_path):
    data, models = str(tmp_path / "data"), str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        jobs.retrain(spark, data, models)
    branches.write(flights, data)
    result = jobs.retrain(spark, data, models, params=model.EnsembleParams.small(), validation_fraction=0.0)
    assert result.risk.count() == 11 and result.drift.count() >= 2
    log = branches.read_branch(spark, f"{models}/metrics")
    assert {r["version"] for r in log.collect()} == {result.version}
    logged = jobs.score_to_log(spark, branches.branch_paths(spark, data)[0], f"{models}/version={result.version}", str(tmp_path / "log"))
    assert spark.read.parquet(logged).count() > 4_000


def test_sigmoid_calibration_rises_with_the_vote_and_survives_storage(spark, flights, tmp_path):
    params = model.EnsembleParams.small()
    params.calibration = "sigmoid"
    fitted, matrix = jobs.fit(flights, params)
    scored = fitted.ensemble.transform(matrix).select("ensemble_vote", "delay_probability", "is_delayed")
    figures = scored.selectExpr("corr(ensemble_vote, delay_probability) AS c", "avg(delay_probability) - avg(is_delayed) AS gap").first()
    assert figures["c"] > 0.95 and abs(figures["gap"]) < 0.02
    fitted.save(str(tmp_path / "model"))
    again = jobs.Fitted.load(spark, str(tmp_path / "model"))
    assert [f.sigmoid for f in again.ensemble.folds] == [f.sigmoid for f in fitted.ensemble.folds]
    with pytest.raises(ValueError, match="calibration"):
        model.DelayEnsemble(["x"], settings=model.EnsembleParams(calibration="none"))


def test_other_labels_are_refused_before_they_are_collected(spark, flights):
    odd = flights.limit(50).withColumn("is_delayed", F.col("distance_miles"))
    with pytest.raises(ValueError, match="labels 0 and 1"):
        model.DelayEnsemble(["distance_miles"]).fit(odd)


def test_a_forest_keeps_the_nodes_of_its_rows(spark):
    assert model._forest(model.ForestParams(), "w", 1).getCacheNodeIds()


def test_fits_read_stored_vectors_and_stored_points(flights, monkeypatch):
    stored = {}

    def keep(df, label, **options):
        stored.setdefault(label, []).append(set(df.columns))
        return materialize(df, label, **options)

    monkeypatch.setattr(model, "materialize", keep)
    jobs.fit(flights, model.EnsembleParams.small())
    assert stored["training"] == [{"label", "features", "_watched", "_fold"}]
    assert stored["points"] == [{"_vote", "label", "n"}] * 3


def test_a_fold_boosts_beside_its_forest(spark, monkeypatch):
    forests, boost, grow = threading.Event(), model.GBTClassifier.fit, model.RandomForestClassifier.fit
    beside = []

    def boosted(self, rows):
        beside.append(forests.wait(20))
        return boost(self, rows)

    def forest(self, rows):
        forests.set()
        return grow(self, rows)

    monkeypatch.setattr(model.GBTClassifier, "fit", boosted)
    monkeypatch.setattr(model.RandomForestClassifier, "fit", forest)
    rows = spark.range(240).selectExpr("id AS flight_id", "id % 7 AS x", "id % 11 AS y", "int(id % 7 > 4) AS is_delayed")
    fitted = model.DelayEnsemble(["x", "y"], settings=model.EnsembleParams.small()).fit(rows)
    assert beside == [True] * 6
    assert [[type(m).__name__[:3] for m in fold.learners] for fold in fitted.folds] == [["GBT", "GBT", "Ran"]] * 3
    assert all(a.getWeightCol() == "_w_scaled" and b.getWeightCol() == "_w_balanced" for a, b, _ in (f.learners for f in fitted.folds))


def test_nodes_of_the_boosted_learners_are_read_beside_the_forest(spark, monkeypatch):
    read, nodes, grow = {k: threading.Event() for k in range(3)}, trees.nodes, model.RandomForestClassifier.fit
    beside = []

    def reading(learner, fold, name, session):
        found = nodes(learner, fold, name, session)
        if name == "b":
            read[fold].set()
        return found

    def forest(self, rows):
        beside.append(read[int(self.getRawPredictionCol()[-1])].wait(60))
        return grow(self, rows)

    monkeypatch.setattr(trees, "nodes", reading)
    monkeypatch.setattr(model.RandomForestClassifier, "fit", forest)
    rows = spark.range(240).selectExpr("id AS flight_id", "id % 7 AS x", "id % 11 AS y", "int(id % 7 > 4) AS is_delayed")
    fitted = model.DelayEnsemble(["x", "y"], settings=model.EnsembleParams.small()).fit(rows)
    assert beside == [True] * 3
    for k, fold in enumerate(fitted.folds):
        assert [(f.fold, f.learner, f.boosted) for f in fold.forests] == [(k, "a", True), (k, "b", True), (k, "c", False)]


def test_a_fold_boosts_both_learners_at_once(spark, monkeypatch):
    boost, both = model.GBTClassifier.fit, {k: threading.Barrier(2) for k in range(3)}

    def boosted(self, rows):
        both[int(self.getRawPredictionCol()[-1])].wait(60)
        return boost(self, rows)

    monkeypatch.setattr(model.GBTClassifier, "fit", boosted)
    rows = spark.range(240).selectExpr("id AS flight_id", "id % 7 AS x", "id % 11 AS y", "int(id % 7 > 4) AS is_delayed")
    fitted = model.DelayEnsemble(["x", "y"], settings=model.EnsembleParams.small()).fit(rows)
    assert [[m.getRawPredictionCol() for m in fold.learners] for fold in fitted.folds] == [[f"_raw_{n}{k}" for n in "abc"] for k in range(3)]


def test_nodes_of_trees_without_a_split(spark):
    rows = spark.range(40).selectExpr("array(0.0D, 0.0D) AS x", "double(id % 4 = 0) AS label", "1.0D AS w")
    rows = rows.withColumn("features", array_to_vector("x"))
    forest = trees.nodes(model._named(model._forest(model.ForestParams(3, 2), "w", 1), "c0").fit(rows), 0, "c", spark)
    assert forest.depths == [0, 0, 0] and forest.threshold.tolist() == [0.0] * 3
    assert np.allclose(forest.margins(np.zeros((2, 2))), forest.value.mean())


def test_votes_and_calibration_are_those_of_mllib(trained, flights):
    fitted = trained[1]
    model_ = fitted.ensemble
    rows = explain._vectors(model_, fitted.features.transform(flights), ["flight_id"])
    voted = model._with_votes(rows, model_.forests())
    assert "ArrowEvalPython" in voted._jdf.queryExecution().executedPlan().toString()
    for k, fold in enumerate(model_.folds):
        for learner in fold.learners:
            voted = learner.transform(voted)
        voted = fold.calibrate(voted, k)
    for k, fold in enumerate(model_.folds):
        parts = [vector_to_array(F.col(m.getProbabilityCol()))[1] for m in fold.learners]
        gap = voted.agg(F.max(F.abs(flight.soft_vote(*parts) - F.col(f"_vote_{k}"))), F.count(F.lit(1))).first()
        assert gap[0] < 1e-12 and gap[1] == flights.count()
        pairs = [(r[0], r[1]) for r in voted.select(f"_vote_{k}", f"_calibrated_{k}").distinct().collect()]
        assert np.abs(fold.curve()(np.array([v for v, _ in pairs])) - [c for _, c in pairs]).max() < 1e-12


def test_occlusion_shuffles_nothing(trained, flights):
    values = explain.occlusion(trained[1].ensemble, trained[1].features.transform(flights))
    assert "Exchange hash" not in values._jdf.queryExecution().executedPlan().toString()


def test_a_block_goes_down_uneven_trees(spark):
    # x0 <= 0.5 ? 1 : (x1 <= 2 ? 2 : 4), and a tree that is one leaf
    leaf = -1
    forest = trees.Forest(
        0, "c", False, np.array([0, 5]), np.array([0.5, 2.0]), np.array([0, -1, 1, -1, -1, -1]), np.array([0.5, 0, 2.0, 0, 0, 0]),
        np.array([1, leaf, 3, leaf, leaf, leaf]), np.array([2, leaf, 4, leaf, leaf, leaf]), np.array([0.0, 1, 3, 2, 4, 10]),
    )
    x = np.array([[0.0, 9.0], [1.0, 2.0], [1.0, 3.0], [np.nan, 3.0]])
    assert forest.depths == [2, 0]
    assert forest.margins(x).tolist() == [20.5, 21.0, 22.0, 22.0]
    assert forest.changes(x).tolist() == [[0, 0], [-0.5, 0], [-1.5, -1.0], [-1.5, -1.0]]
    assert trees.rowwise(lambda b: b, pa.array([], pa.list_(pa.float64()))).to_pylist() == []
