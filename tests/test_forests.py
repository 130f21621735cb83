import math
import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators import training


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(300, numPartitions=2).select(
        F.col("id").cast("string").alias("sku_id"),
        *[((F.col("id") * k) % 97).cast("double").alias(c) for k, c in zip((3, 7, 11, 31), fv.MODEL_FEATURES)],
        ((F.col("id") * 3) % 97 + (F.col("id") * 7) % 97 / 5).alias("demand_qty"))
    return training.training_frame(rows, keep=("sku_id",)).cache()


def test_a_cut_forest_is_the_forest_of_that_depth(frame):
    """With all features at every node nothing is drawn per node, so the trees can be compared."""
    forest = {"n_estimators": 5, "max_features": "all", "min_samples_leaf": 2}
    deep = training.fit_model(frame, "rf", forest | {"max_depth": 5})
    found = training.staged_forest_errors(deep, frame, [(5, 5), (5, 3)])
    evaluator = RegressionEvaluator(metricName="mae")
    for depth, error in zip((5, 3), found):
        own = training.fit_model(frame, "rf", forest | {"max_depth": depth})
        assert error == pytest.approx(evaluator.evaluate(own.transform(frame)), rel=1e-12)


def test_a_grid_of_forests_fits_once_a_fold(frame, monkeypatch):
    fits, fit = [], training.fit_model
    monkeypatch.setattr(training, "fit_model", lambda *a, **k: fits.append(a) or fit(*a, **k))
    grid = {"n_estimators": [2, 4], "max_depth": [2, 4]}
    model, best, trials = training.grid_search(frame, "rf", grid, "sku_id")
    assert len(fits) == 4 and len(trials) == 4
    assert (model.getNumTrees, best) == (best["n_estimators"], min(trials, key=lambda t: t[1])[0])


def test_forests_that_share_nothing_stay_apart():
    space = [{"n_estimators": 100, "max_depth": 2}, {"n_estimators": 5, "max_depth": 20},
             {"n_estimators": 100, "max_depth": 2, "min_samples_leaf": 7}, {"n_estimators": 1}]
    assert sorted(m for _, _, m in training.shared_forests(space, 4)) == [[0], [1], [2], [3]]
    alike = [{"n_estimators": n, "max_depth": 4, "max_features": f} for n, f in ((9, "sqrt"), (5, "log2"))]
    assert training.shared_forests(alike, 4) == [(9, 4, [0, 1])]


def _many(spark):
    rng = random.Random(5)
    rows = [(str(i), float(rng.randrange(8)), float(rng.randrange(6)) / 4, rng.gauss(0, 1)) for i in range(6000)]
    df = spark.createDataFrame([(i, a, b, 3 * a - 5 * (b > 0.6) * a + c) for i, a, b, c in rows],
                               "sku_id string, a double, b double, label double")
    return training.training_frame(df, ["a", "b"], "label", ("sku_id",)).cache()


def test_a_search_over_many_rows_fits_forests_to_points(spark, monkeypatch):
    frame = _many(spark)
    candidates = [{"n_estimators": 20, "max_depth": d, "max_features": "all", "min_samples_leaf": 4} for d in (1, 6)]
    fitted, make = [], training.like_rows
    monkeypatch.setattr(training, "like_rows", lambda *a: fitted.append(make(*a).count()) or make(*a))
    _, _, by_rows = training.search_forest(frame, candidates, "sku_id")
    assert not fitted
    monkeypatch.setattr(training, "SINGLE_ROWS", 300)
    model, best, by_points = training.search_forest(frame, candidates, "sku_id")
    assert len(fitted) == 4 and max(fitted) < 600  # three folds and the winner, 48 cells each
    for (_, rows), (_, points) in zip(by_rows, by_points):
        assert points == pytest.approx(rows, rel=0.05)
    assert best == candidates[1] and model.getNumTrees == 20
    error = RegressionEvaluator(metricName="mae").evaluate(model.transform(frame))
    assert error == pytest.approx(by_points[1][1], rel=0.1)  # its limits are those of the features themselves


def test_leaves_of_points_hold_as_many_rows(spark):
    """A leaf's least number is of rows, whatever number of points they make."""
    frame = _many(spark)
    limits = training.split_points(frame, 32)
    points = training.like_rows(frame, limits, 40)
    forest = training.make_estimator("rf", {"n_estimators": 1, "max_depth": 8, "max_features": "all", "min_samples_leaf": 900})
    own = training.for_points(forest, 6000).fit(points)
    got = own.transform(points).groupBy("prediction").agg(F.sum("weight").alias("rows")).collect()
    assert len(got) > 1 and min(r["rows"] for r in got) >= 900
    assert math.isclose(sum(r["rows"] for r in got), 6000)
