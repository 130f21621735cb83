"""Search that uses its history: better than random draws, the same for the same seed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators import training
from tagsmith.operators.sequential import Choice, Uniform, propose, sequential_search

SPACE = {"x": Uniform(-5.0, 5.0), "rate": Uniform(1e-4, 1.0, log=True), "kind": Choice(("a", "b", "c", "d"))}


def _error(p):
    return (p["x"] - 1.7) ** 2 + (math.log10(p["rate"]) + 2.5) ** 2 + {"a": 2, "b": 0, "c": 1, "d": 3}[p["kind"]]


def test_less_error_than_random_draws():
    found, drawn = [], []
    for seed in range(20):
        found.append(min(e for _, e in sequential_search(_error, SPACE, 50, seed)[1]))
        rng = random.Random(seed)
        drawn.append(min(_error({k: d.draw(rng) for k, d in SPACE.items()}) for _ in range(50)))
    assert sum(found) < 0.7 * sum(drawn) and sum(a < b for a, b in zip(found, drawn)) >= 13


def test_same_seed_same_trials_and_all_inside():
    best, trials = sequential_search(_error, SPACE, 50, 3)
    assert sequential_search(_error, SPACE, 50, 3) == (best, trials) and len(trials) == 50
    assert sequential_search(_error, SPACE, 50, 4)[1] != trials
    assert all(-5 <= p["x"] <= 5 and 1e-4 <= p["rate"] <= 1 and p["kind"] in "abcd" for p, _ in trials)
    assert best == min(trials, key=lambda t: t[1])[0]
    # the draws that follow depend on the errors before them
    other = sequential_search(lambda p: -_error(p), SPACE, 50, 3)[1]
    assert [p for p, _ in other[:10]] == [p for p, _ in trials[:10]] and other[10][0] != trials[10][0]


def test_odd_errors():
    best, trials = sequential_search(lambda p: math.nan if p["kind"] != "c" else 1.0, SPACE, 30, 1)
    assert best["kind"] == "c" and any(e == math.inf for _, e in trials)
    assert sequential_search(lambda p: 0.0, {}, 3)[0] == {}
    with pytest.raises(ValueError):
        sequential_search(_error, SPACE, 0)
    assert set(propose({"k": Choice(("only",))}, [({"k": "only"}, 1.0)] * 12, random.Random(1)).values()) == {"only"}


def test_models_searched_on_spark(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("s"), "id").alias("sku_id"), (F.col("id") % 17 + 1.0).alias("price"), (F.col("id") % 5 + 1.0).alias("competitor_price"),
        (F.col("id") % 3 + 0.0).alias("inventory_level"), F.lit(0.0).alias("price_diff_pct"), ((F.col("id") % 17) * 3.0).alias("demand_qty"))
    frame = training.training_frame(rows, list(fv.MODEL_FEATURES), keep=("sku_id",)).cache()
    space = {"num_leaves": Choice((2, 8)), "learning_rate": Uniform(0.05, 1.0, log=True), "n_estimators": Choice((1,))}
    model, params, trials = training.sequential_model_search(frame, "lightgbm", space, "sku_id", trials=3, folds=2)
    assert len(trials) == 3 and params == min(trials, key=lambda t: t[1])[0] and len(model.trees) == 1
    assert training.search(frame, "lightgbm", [params], "sku_id", 2)[2] == [(params, min(e for _, e in trials))]
