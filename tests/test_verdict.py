"""Cases that earlier versions got wrong."""

import math

import pytest
from pyspark.sql import functions as F

from tagsmith.functions.numeric import exact_total, price_text
from tagsmith.operators import evaluation, registry, training
from tagsmith.operators.ordering import running_total


def _versions(spark, *names):
    rows = [("m", n, "prod", f"2024-01-{i + 1:02d}", f"/p/{i}", "Staging" if i else "Production") for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows, "model_name string, model_version string, environment string, created_at string, model_path string, stage string")


def _stages(df):
    return {(r["model_version"], r["model_path"]): r["stage"] for r in df.collect()}


def test_only_the_highest_dotted_version_is_promoted(spark):
    got = _stages(registry.promote_latest(_versions(spark, "v1.0", "v1.10", "v1.9", "v1.10")))
    assert [k for k, v in got.items() if v == "Production"] == [("v1.10", "/p/3")]
    assert got["v1.0", "/p/0"] == "Archived"


def test_rollback_to_an_unknown_version_changes_nothing(spark):
    before = _versions(spark, "v1", "v2")
    assert _stages(registry.rollback(before, "m", "v9")) == _stages(before)
    assert _stages(registry.rollback(before, "m", "v2")) == {("v1", "/p/0"): "Archived", ("v2", "/p/1"): "Production"}
    with pytest.raises(ValueError, match="no version"):
        registry.rollback(before, "m", "v9", must_exist=True)


def test_zero_actuals_are_not_left_out(spark):
    got = evaluation.regression_metrics(spark.createDataFrame([(0.0, 5.0), (2.0, 2.0), (4.0, 4.0)], "actual double, predicted double")).first()
    assert got["pseudo_accuracy"] is None and got["zero_actuals"] == 1


def test_totals_survive_any_amount(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e14,), (0.25,), (None,)], "x double")
    total = df.agg(exact_total(F.col("x"))).first()[0]
    assert math.isclose(total, 1e14 + 0.25, rel_tol=1e-15)


def test_unknown_parameters_are_an_error():
    with pytest.raises(ValueError, match="num_leaves"):
        training.make_estimator("xgboost", {"num_leaves": 31})
    with pytest.raises(ValueError, match="bagging"):
        training.boosting_params({"num_leaves": 31, "bagging": 0.5})
    assert training.boosting_params({"num_leaves": 63}).num_leaves == 63


def test_prices_as_text_have_no_exponent(spark):
    df = spark.createDataFrame([(15000000.0,), (12.5,), (9999999.994,), (123456789.126,), (0.01,), (None,)], "x double")
    assert [r[0] for r in df.select(price_text(F.col("x"))).collect()] == [
        "15000000.0", "12.5", "9999999.99", "123456789.13", "0.01", None]


def test_running_total_over_many_ranges(spark):
    """More ranges than one block of totals holds, and ranges without rows."""
    df = spark.range(0, 3000, 1, 3).select((F.col("id") * 7 % 3000).alias("k"), (F.col("id") % 5).alias("n"))
    got = sorted(running_total(df, "k", ["n"], parts=600).collect())
    before = 0
    for _, n, total in got:
        assert total == before
        before += n
    assert len(got) == 3000
