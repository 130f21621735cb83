"""Leaf-wise trees against a plain Python growth, and tree models inside the row against Spark ML."""

import random
from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators import boosting, training, tree_demand
from tagsmith.operators.boosting import BoostedModel, BoostingParams
from tagsmith.operators.demand_models import LinearDemand, MLlibDemand
from tagsmith.plans.training import TrainingSpec, registered_model, train, train_and_register

NAMES = list(fv.MODEL_FEATURES)


def columns():
    return tuple(F.col(c) for c in NAMES)


def _rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        price, stock = rng.randrange(5, 40) / 2, float(rng.randrange(0, 9))
        other, gap = rng.choice([price, price + 1, price - 1]), 3.5
        out.append((f"s{i}", price, other, stock, gap, round(200 / price + 7 * stock - other + rng.random(), 3)))
    return out


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(_rows(400), f"sku_id string, {', '.join(f'{c} double' for c in NAMES)}, demand_qty double")


def _plain(rows, p):
    """One split after the other, from sorted values; residuals in millionths."""
    data = [(r[1:5], round(r[5] * 1_000_000)) for r in rows]
    n = len(data)
    edges = []
    for i in range(4):
        x = sorted(d[0][i] for d in data)
        edges.append(sorted({x[max(-(-k * n // p.max_bin) - 1, 0)] for k in range(1, p.max_bin)}))
    base = sum(y for _, y in data) // n
    residual, trees, rate = [y - base for _, y in data], [], Fraction(str(p.learning_rate))
    for _ in range(p.n_estimators):
        node, splits = [1] * n, {}
        while len(splits) + 1 < p.num_leaves:
            best = None
            for k in sorted(set(node)):
                own = [j for j in range(n) if node[j] == k]
                g = sum(residual[j] for j in own)
                for i in range(4):
                    for edge in edges[i]:
                        left = [j for j in own if data[j][0][i] < edge]
                        a, b = len(left), len(own) - len(left)
                        if k.bit_length() <= p.max_depth and min(a, b) >= p.min_child_samples:
                            gl = sum(residual[j] for j in left)
                            gain = float(gl) * gl / a + float(g - gl) * (g - gl) / b - float(g) * g / len(own)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = gain, k, i, edge
            if best is None:
                break
            _, k, i, edge = best
            splits[k] = (NAMES[i], edge)
            node = [2 * k + (data[j][0][i] >= edge) if node[j] == k else node[j] for j in range(n)]
        leaves = {}
        for k in set(node):
            own = [j for j in range(n) if node[j] == k]
            value = rate.numerator * sum(residual[j] for j in own) // (rate.denominator * len(own))
            leaves[k] = len(own), value
        residual = [r - leaves[k][1] for r, k in zip(residual, node)]
        trees.append((splits, leaves))
    return base, trees, [(y - r) / 1_000_000 for (_, y), r in zip(data, residual)]


@pytest.mark.parametrize("params", [
    BoostingParams(3, 0.3, 7, 6, 5, 20), BoostingParams(2, 0.1, 31, 3, 1, 255), BoostingParams(2, 0.05, 4, 60, 100, 8),
    BoostingParams(2, 0.5, 1), BoostingParams(1, 0.5, 31, 6, 300)])
def test_trees_equal_plain_growth(spark, golden, params):
    base, trees, fitted = _plain(_rows(400), params)
    for parts in (1, 5):
        model = boosting.fit_boosted(golden.repartition(parts), NAMES, params=params)
        assert model.base == base
        assert [({n: (NAMES[s.feature], model.threshold(s)) for n, s in t.splits.items()}, t.leaves) for t in model.trees] == trees
    scored = tree_demand.from_boosted(model).score(golden, "p", columns()).collect()
    assert {r["sku_id"]: r["p"] for r in scored} == {r[0]: p for r, p in zip(_rows(400), fitted)}


def test_many_rounds_cut_the_plan(spark, golden):
    params = BoostingParams(boosting.ROUNDS_IN_A_PLAN + 2, 0.3, 3, 6, 50)
    model = boosting.fit_boosted(golden, NAMES, params=params)
    assert [t.leaves for t in model.trees] == [t[1] for t in _plain(_rows(400), params)[1]]
    short = boosting.fit_boosted(golden, NAMES, params=BoostingParams(2, 0.3, 3, 6, 50))
    assert short.trees == model.trees[:2]


def test_odd_rows(spark, golden):
    schema = golden.schema
    few = BoostingParams(2, 0.5, 4, 6, 1)
    empty = boosting.fit_boosted(golden.where("false"), NAMES, params=few)
    assert not empty.trees and empty.base == 0
    assert tree_demand.from_boosted(empty).score(golden, "p", columns()).agg(F.max(F.abs("p"))).first()[0] == 0.0
    odd = [("a", None, 1.0, 1.0, 1.0, 5.0), ("b", float("nan"), 1.0, 1.0, 1.0, 5.0), ("c", 1.0, 1.0, 1.0, 1.0, None)]
    rows = golden.unionByName(spark.createDataFrame(odd, schema))
    assert boosting.fit_boosted(rows, NAMES, params=few).trees == boosting.fit_boosted(golden, NAMES, params=few).trees
    same = boosting.fit_boosted(spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 4.0)] * 30, schema), NAMES, params=few)
    assert [t.leaves for t in same.trees] == [{1: (30, 0)}] * 2 and same.base == 4_000_000
    scored = tree_demand.from_boosted(same).score(rows, "p", columns()).where("sku_id IN ('a', 'b')")
    assert {r["sku_id"]: r["p"] for r in scored.collect()}["a"] is None
    negative = spark.createDataFrame([(str(i), float(i), 1.0, 1.0, 1.0, -0.7 * i) for i in range(50)], schema)
    assert boosting.fit_boosted(negative, NAMES, params=BoostingParams(2, 0.3, 5, 6, 3)).trees[1].leaves == _plain(
        [(str(i), float(i), 1.0, 1.0, 1.0, -0.7 * i) for i in range(50)], BoostingParams(2, 0.3, 5, 6, 3))[1][1][1]
    with pytest.raises(ValueError):
        BoostingParams(max_depth=0)


def test_save_load_and_importances(spark, golden, tmp_path):
    model = boosting.fit_boosted(golden, NAMES, params=BoostingParams(2, 0.3, 5))
    model.save(f"{tmp_path}/m", spark)
    assert BoostedModel.load(f"{tmp_path}/m", spark) == model
    shares = dict(training.feature_importances(model))
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["price_diff_pct"] == 0 and shares["inventory_level"] > 0
    assert model.nodes(spark).where("value IS NULL").count() == sum(len(t.splits) for t in model.trees)


def test_one_fit_serves_all_its_beginnings(spark, golden):
    frame = training.training_frame(golden, keep=("sku_id",))
    candidates = [{"n_estimators": n, "learning_rate": 0.4, "num_leaves": 4} for n in (3, 1, 2)] + [
        {"n_estimators": 1, "learning_rate": 0.9, "num_leaves": 4}]
    model, best, trials = training.search(frame, "lightgbm", candidates, "sku_id", folds=2)
    folds = training.with_folds(frame, "sku_id", 2)
    for params, error in trials:
        want = 0.0
        for fold in range(2):
            own = training.fit_model(folds.where(F.col("fold") != fold), "lightgbm", params)
            judged = training.predictions(own, folds.where(F.col("fold") == fold))
            want += judged.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] / 2
        assert error == pytest.approx(want, abs=1e-12)
    assert best == min(trials, key=lambda t: t[1])[0] and len(model.trees) == best["n_estimators"]
    assert training.random_search.__defaults__[1] == 20
    with pytest.raises(ValueError):
        training.fit_model(frame, "lightgbm", {"subsample": 0.5})


@pytest.mark.parametrize("kind,settings", [
    (GBTRegressor, {"maxIter": 4, "maxDepth": 3, "seed": 1}), (RandomForestRegressor, {"numTrees": 5, "maxDepth": 4, "seed": 1}),
    (DecisionTreeRegressor, {"maxDepth": 3}), (DecisionTreeRegressor, {"maxDepth": 0}), (LinearRegression, {})])
def test_models_inside_the_row_equal_spark_ml(spark, golden, kind, settings):
    frame = training.training_frame(golden, keep=("sku_id",))
    fitted = kind(featuresCol="features", labelCol="label", **settings).fit(frame)
    for model in (fitted, training.as_pipeline(fitted)):
        inside = tree_demand.demand_model(spark, model)
        assert isinstance(inside, (tree_demand.TreeDemand, LinearDemand))
        both = inside.score(MLlibDemand(fitted).score(golden, "wanted", columns()), "got", columns())
        assert both.where(F.abs(F.col("got") - F.col("wanted")) > 1e-9).count() == 0 and both.where("got IS NULL").count() == 0
        assert "udf" not in inside.score(golden, "p", columns())._jdf.queryExecution().toString().lower()
    grid = golden.withColumn("grid", F.array(F.col("price"), F.col("price") * 2, F.lit(0.0)))
    rest = columns()[1:]
    rows, demand = inside.score_grid(grid, "grid", 3, rest)
    rows = rows.withColumn("got", F.transform("grid", demand))
    for i in range(3):
        one = MLlibDemand(fitted).score(rows, "wanted", (F.col("grid")[i], *rest))
        assert one.where(F.abs(F.col("got")[i] - F.col("wanted")) > 1e-9).count() == 0


def test_trained_registered_and_priced(spark, golden, tmp_path):
    spec = TrainingSpec("lightgbm", params={"n_estimators": 2, "num_leaves": 4})
    out = train(golden, spec)
    assert out["scored"].count() > 0 and out["metrics"].first()["r2"] > 0
    train_and_register(golden, spec, f"{tmp_path}/models", f"{tmp_path}/registry", datetime(2024, 1, 1))
    model = registered_model(spark, f"{tmp_path}/registry", "lightgbm")
    assert model == tree_demand.from_boosted(out["model"])
    with pytest.raises(ValueError):
        tree_demand.demand_model(spark, boosting.fit_boosted(golden, ["price"], params=BoostingParams(1)))


def test_fits_to_a_fold_share_its_binned_rows(spark, golden, monkeypatch):
    """A search sorts and bins the rows of a fold once for all its fits; the winner's fit bins all rows."""
    frame, made, binned = training.training_frame(golden, keep=("sku_id",)), [], boosting.bin_rows

    def counted(*args):
        made.append(args[3])
        return binned(*args)

    monkeypatch.setattr(training, "bin_rows", counted)
    candidates = [{"n_estimators": 1, "num_leaves": n, "max_bin": m} for n in (2, 3) for m in (15, 255)]
    _, _, trials = training.search(frame, "lightgbm", candidates, "sku_id", folds=2)
    assert sorted(made) == [15, 15, 255, 255]
    alone = [training.search(frame, "lightgbm", [c], "sku_id", folds=2, refit=False)[2][0] for c in candidates]
    assert trials == alone


def test_staged_errors_equal_scores_in_the_row(spark, golden):
    frame = training.training_frame(golden, keep=("sku_id",))
    model = training.fit_model(frame, "lightgbm", {"n_estimators": 3, "num_leaves": 5, "learning_rate": 0.3})
    missing = frame.limit(1).withColumn("label", F.lit(None).cast("double"))
    judged = frame.unionByName(missing)
    found = training.staged_errors(model, judged, [0, 3, 1])
    values = training.vector_to_array("features")
    for k, error in zip([0, 3, 1], found):
        scored = tree_demand.from_boosted(model, k).score(frame, "p", tuple(values[i] for i in range(4)))
        assert error == pytest.approx(scored.agg(F.avg(F.abs(F.col("label") - F.col("p")))).first()[0], abs=1e-12)
    with pytest.raises(ValueError):
        training.staged_errors(model, frame.where("false"), [1])


def test_boosted_trees_of_many_rows_are_fitted_to_alike_ones(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(float(rng.randrange(8)), float(rng.randrange(6)) / 4, rng.gauss(0, 1)) for _ in range(4000)]
    df = spark.createDataFrame([(a, b, 3 * a - 5 * (b > 0.6) * a + c) for a, b, c in rows], "a double, b double, label double")
    frame = training.training_frame(df, ["a", "b"], "label").cache()
    params = {"n_estimators": 8, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0}
    want = {tuple(r["features"]): r["prediction"] for r in training.fit_model(frame, "xgboost", params).transform(frame).collect()}

    def of(n):
        monkeypatch.setattr(training, "SINGLE_ROWS", n)
        model = training.fit_model(frame, "xgboost", params)
        return model, {tuple(r["features"]): r["prediction"] for r in model.transform(frame).collect()}

    limits = training.split_points(frame, 32)
    assert limits == [[k + 0.5 for k in range(7)], [k / 4 + 0.125 for k in range(5)]]
    points = training.like_rows(frame, limits, 40)
    got = points.agg(F.count("*"), F.sum("weight"), F.max("weight")).first()
    assert got[0] <= 48 + 100 and got[1] == 4000 and got[2] < 80
    for n in (100, 3999):
        model, found = of(n)
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert model.getNumTrees == 8 and abs(sum(model.featureImportances.toArray()) - 1) < 1e-9
    scored = tree_demand.from_mllib(spark, model).score(df, "s", (F.col("a"), F.col("b"))).collect()
    assert all(abs(r["s"] - want[r["a"], r["b"]]) < 1e-9 for r in scored)


def test_points_have_limits_that_rows_fall_by(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.random() ** 3, rng.gauss(0, 1) if rng.random() < 0.5 else 0.25) for _ in range(3000)]
    df = spark.createDataFrame([(a, b, (a > 0.1) * 7.0 + (b > 0.3)) for a, b in rows], "a double, b double, label double")
    frame = training.training_frame(df, ["a", "b"], "label").cache()
    limits = training.split_points(frame, 32)
    assert all(0 < len(x) < 32 and x == sorted(set(x)) for x in limits)
    monkeypatch.setattr(training, "SINGLE_ROWS", 500)
    model = training.fit_model(frame, "xgboost", {"n_estimators": 20, "learning_rate": 0.3})
    trees = [t.toDebugString for t in model.trees]
    used = {float(line.split("<=")[1].strip(" )")) for t in trees for line in t.splitlines() if "<=" in line}
    assert used and used <= {v for x in limits for v in x}
    worst = model.transform(frame).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert worst < 0.3
    with pytest.raises(Exception, match="[Ll]abel"):
        training.fit_model(frame.withColumn("label", F.when(F.col("label") < 8, F.col("label"))), "xgboost", {"n_estimators": 2})
