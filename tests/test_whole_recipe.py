"""The registered model queries fit the full recipe, and a forest grown in parts is one forest."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from skylag.operators import model, trees
from skylag.plans import catalog


def test_model_queries_fit_every_round_and_every_tree(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog, "_MODELS", {})
    monkeypatch.setattr(catalog.views, "flights", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog.jobs, "fit", lambda flights, params: (asked.append(params), None))
    catalog._model(spark, "nowhere")
    params = asked[0]
    assert [(b.max_iter, b.max_depth, b.validation_tol) for b in (params.boosted_first, params.boosted_second)] == [(400, 6, 0.0)] * 2
    assert (params.forest.num_trees, params.forest.max_depth) == (250, 12)


def test_a_forest_grown_in_parts_is_one(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(model, "TREES_AT_ONCE", 2)
    rows = spark.range(300).selectExpr("array(double(id % 7), double(id % 11)) AS x", "double(id % 7 > 4) AS label", "1.0D AS w")
    rows = rows.withColumn("features", array_to_vector("x"))
    grown, parts, joined = [], [], model._joined
    monkeypatch.setattr(model, "_joined", lambda some, session: (parts.extend(some), grown.append(joined(some, session)))[1] or grown[-1])
    with ThreadPool(1) as pool:  # as the folds are: a thread that has no active session
        forest = pool.apply(model._grown, (model.ForestParams(5, 3), "w", 1, "c0", rows))
    assert [p.getNumTrees for p in parts] == [2, 2, 1] and forest.getNumTrees == 5
    assert len({t for p in parts for t in [p.toDebugString]}) == 3  # no part repeats another
    forest.write().save(str(tmp_path / "forest"))
    again = RandomForestClassificationModel.load(str(tmp_path / "forest"))
    x = np.array([[a, b] for a in range(7) for b in range(11)], dtype=float)
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, x array<double>").withColumn("features", array_to_vector("x"))

    def late(m):
        found = m.transform(points).select("i", vector_to_array(F.col("_prob_c0"))[1].alias("p")).orderBy("i").collect()
        return np.array([r["p"] for r in found])

    mean = sum(p.getNumTrees * late(p) for p in parts) / 5
    assert np.abs(late(forest) - mean).max() < 1e-12 and np.abs(late(again) - mean).max() < 1e-12
    assert np.abs(trees.nodes(forest, 0, "c", spark).margins(x) - mean).max() < 1e-12
