"""Branch tables for the rules, brute force for the sweep."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagsmith.operators import elasticity
from tagsmith.operators.demand_models import LinearDemand, PandasDemand
from tagsmith.operators.hybrid import choose_price
from tagsmith.operators.rules import batch_rules, service_rules
from tagsmith.operators.sweep import ai_output, sweep_prices
from tagsmith.plans.pricing import PricingSettings, new_run, price, run_pricing

MASTER = ("sku_id string, current_price double, competitor_price double, competitor_name string, "
          "price_diff_pct double, demand_bucket string, inventory_bucket string, "
          "competitor_bucket string, total_inventory double, demand_qty double")
NAN = float("nan")

CASES = [
    # name, rival, gap, demand, stock, position, price, reason, alert
    ("above", 94.0, 6.38, "LOW", "LOW", "COMPETITOR_CHEAPER", 100.0,
     "Manual review required (large price gap)", True),
    ("below", 106.0, -5.66, "LOW", "LOW", "WE_CHEAPER", 100.0,
     "Manual review required (large price gap)", True),
    ("edge5", 95.24, 5.0, "LOW", "LOW", "COMPETITOR_CHEAPER", 95.24 * 0.99, "Match shop", False),
    ("edge2", 98.04, 2.0, "LOW", "LOW", "COMPETITOR_CHEAPER", 98.04 * 0.999,
     "Auto match competitor (0.1% lower)", False),
    ("clear", None, None, "LOW", "VERY_HIGH", "NO_COMPETITOR", 70.0, "Stock clearance 30%", False),
    ("mono", None, None, "HIGH", "MED", "NO_COMPETITOR", 125.0, "Monopoly premium 25%", False),
    ("big", 103.0, -2.91, "HIGH", "LOW", "WE_CHEAPER", 120.0, "Big increase", False),
    ("inc", 100.0, None, "HIGH", "LOW", "SAME", 110.00000000000001, "Increase", False),
    ("none", None, None, "MED", "HIGH", "NO_COMPETITOR", 100.0, "No change", False),
    ("nan", NAN, NAN, "MED", "HIGH", "NO_COMPETITOR", 100.0, "No change", False),
    ("zero", 0.0, 0.0, "MED", "HIGH", "SAME", 100.0, "No change", False),
]


def master(spark, rows):
    return spark.createDataFrame(
        [(n, 100.0, rival, "shop", gap, demand, stock, pos, 10.0, 5.0)
         for n, rival, gap, demand, stock, pos, *_ in rows], MASTER)


def test_batch_rule_branches(spark):
    got = {r["sku_id"]: r for r in batch_rules(master(spark, CASES)).collect()}
    for name, *_, want, reason, alert in CASES:
        row = got[name]
        assert (row["decision_reason"], row["alert_flag"]) == (reason, alert), name
        assert row["new_price"] == want, name


def test_unknown_competitor_name_leaves_no_null(spark):
    rows = master(spark, CASES[2:3]).withColumn("competitor_name", F.lit(None).cast("string"))
    assert batch_rules(rows).first()["decision_reason"] == "Match "


def test_service_rule_branches(spark):
    rows = spark.createDataFrame(
        [("gap", 100.0, 80.0, "a", 25.0), ("edge", 100.0, 83.0, "a", 20.0),
         ("match", 100.0, 100.05, "a", 0.0), ("under", 100.0, 95.0, "a", 5.0),
         ("none", 100.0, None, None, 0.0), ("zero", 100.0, 0.0, "a", 50.0)],
        "sku_id string, current_price double, competitor_price double, competitor_name string, "
        "price_diff_pct double")
    got = {r["sku_id"]: (r["new_price"], r["pricing_reason"], r["alert_flag"])
           for r in service_rules(rows).collect()}
    assert got == {
        "gap": (100.0, "RULE_OVERRIDE_ALERT", True),
        "edge": (82.92, "RULE_MATCH_COMPETITOR", False),
        "match": (100.05, "RULE_AUTO_MATCH", False),
        "under": (94.9, "RULE_MATCH_COMPETITOR", False),
        "none": (100.0, "NO_COMPETITOR", False),
        "zero": (100.0, "NO_COMPETITOR", False),
    }


# --- sweep --------------------------------------------------------------------------------------
def _linear(p, rival, stock, gap):
    return 300.0 + 0.5 * rival + 0.01 * stock + -3.0 * gap + -2.0 * p


MODEL = LinearDemand(300.0, price=-2.0, competitor=0.5, inventory=0.01, gap=-3.0)


def _expected(cp, rival, stock, gap, qty, baseline, tolerance):
    """Straight loop over the candidates."""
    if baseline == "batch":
        rival = cp if rival is None or rival == 0 else rival
        base_qty = 1.0 if qty is None or qty == 0 else qty
    else:
        rival = cp if rival is None else rival
        base_qty = (qty or 0.0) if baseline == "service" else max(qty or 0.0, 0.1)
    base = cp * base_qty
    best, price, reason = base, cp, "NO_IMPROVEMENT"
    for p in np.linspace(cp * 0.7, cp * 1.3, 15):
        if rival and p > rival:
            continue
        earned = p * max(_linear(p, rival, stock or 0.0, gap or 0.0), 0.0)
        if earned > best:
            best, price, reason = earned, p, "AI_REVENUE_OPTIMIZED"
    if base > 0 and (best - base) / base < -tolerance:
        return cp, "REJECTED_LOW_REVENUE"
    return float(np.round(price, 2)), reason


def _random_rows(n=400, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cp = float(np.round(rng.uniform(5, 200), 2))
        rival = [None, 0.0, cp, float(np.round(cp * rng.uniform(0.5, 1.4), 2))][rng.integers(4)]
        rows.append((str(i), cp, rival, [None, float(rng.integers(0, 900))][rng.integers(2)],
                     [None, float(np.round(rng.uniform(-30, 30), 2))][rng.integers(2)],
                     [None, 0.0, float(rng.integers(1, 300))][rng.integers(3)]))
    return rows


SWEEP = ("sku_id string, current_price double, competitor_price double, total_inventory double, "
         "price_diff_pct double, demand_qty double")


@pytest.mark.parametrize("baseline", ["batch", "service", "single"])
@pytest.mark.parametrize("tolerance", [0.05, -0.4])
def test_sweep_equals_loop(spark, baseline, tolerance):
    rows = _random_rows()
    df = spark.createDataFrame(rows, SWEEP).withColumns(
        {"alert_flag": F.lit(False), "new_price": F.lit(1.0)})
    got = {r["sku_id"]: (r["ai_optimal_price"], r["pricing_reason"])
           for r in sweep_prices(df, MODEL, baseline, tolerance).collect()}
    for sku, *values in rows:
        assert got[sku] == _expected(*values, baseline, tolerance), (sku, values)


def test_sweep_with_a_python_model_and_alerts(spark):
    df = spark.createDataFrame(_random_rows(120), SWEEP).withColumns(
        {"alert_flag": (F.col("sku_id").cast("int") % 5) == 0, "new_price": F.lit(7.0)})
    foreign = PandasDemand(
        lambda f: 300.0 + 0.5 * f["competitor_price"] + 0.01 * f["inventory_level"]
        + -3.0 * f["price_diff_pct"] + -2.0 * f["price"])
    key = lambda rows: sorted((r["sku_id"], r["ai_optimal_price"], r["pricing_reason"],
                               r["ai_strategy"]) for r in rows)
    native = key(ai_output(df, MODEL).collect())
    assert native == key(ai_output(df, foreign).collect())
    alerts = [r for r in native if int(r[0]) % 5 == 0]
    assert all(r[1:] == (7.0, "RULE_OVERRIDE_ALERT", "RULE_OVERRIDE") for r in alerts)
    assert {r[3] for r in native if int(r[0]) % 5} == {"AI_OPTIMIZED"}


def test_nothing_below_seventy_percent_of_price(spark):
    df = spark.createDataFrame([("a", 100.0, 60.0, 1.0, 0.0, 3.0)], SWEEP).withColumns(
        {"alert_flag": F.lit(False), "new_price": F.lit(1.0)})
    row = sweep_prices(df, MODEL).first()
    assert (row["ai_optimal_price"], row["pricing_reason"]) == (100.0, "NO_IMPROVEMENT")


# --- elasticity and hybrid --------------------------------------------------------------------------
def _fit_loop(bp, bd):
    x = np.linspace(bp * 0.7, bp * 1.3, 12)
    y = bd * (bp / x)
    b, a = np.polyfit(x, y, 1)
    p = a + b * x
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    return b, a, round(r2, 4), round(abs(y - p).mean(), 2), round(
        float(np.mean(np.abs((y - p) / (y + 1))) * 100), 2)


def test_fit_equals_least_squares(spark):
    rows = [("a", 100.0, 5.0), ("b", 12.34, 900.0), ("c", 2999.0, 1.0), ("d", 10.0, 0.0),
            ("e", 0.0, 5.0), ("f", None, 5.0)]
    df = spark.createDataFrame(rows, "sku_id string, current_price double, demand_qty double")
    got = {r["sku_id"]: r for r in elasticity.fit(elasticity.base_point(df)).collect()}
    assert set(got) == {"a", "b", "c"}
    for sku, bp, bd in rows[:3]:
        b, a, r2, mae, mape = _fit_loop(bp, bd)
        row = got[sku]
        assert math.isclose(row["slope"], b, rel_tol=1e-8)
        assert math.isclose(row["intercept"], a, rel_tol=1e-8)
        assert (row["elasticity_r2"], row["elasticity_mae"], row["elasticity_mape"]) == (
            r2, mae, mape)
    own = {r["sku_id"]: r for r in elasticity.with_own_fit(df).collect()}
    assert own["d"]["slope"] is None and own["e"]["elasticity_r2"] is None
    assert own["b"]["elasticity_mape"] == got["b"]["elasticity_mape"]
    best = {r["sku_id"]: r["elasticity_price"]
            for r in elasticity.optimal_price(elasticity.with_own_fit(df)).collect()}
    for sku, bp, bd in rows[:3]:
        b, a, *_ = _fit_loop(bp, bd)
        grid = np.linspace(bp * 0.7, bp * 1.3, 20)
        earned = [p * max(a + b * p, 0) for p in grid]
        assert best[sku] == round(float(grid[int(np.argmax(earned))]), 2)
    assert best["d"] == 10.0


def test_base_point_takes_one_row_per_sku(spark):
    df = spark.createDataFrame([("a", 20.0, 5.0), ("a", 10.0, 7.0)],
                               "sku_id string, current_price double, demand_qty double")
    assert [tuple(r) for r in elasticity.base_point(df).collect()] == [("a", 10.0, 7.0)]


def test_hybrid_choice(spark):
    df = spark.createDataFrame(
        [("alert", 10.0, 11.0, 12.0, True, 0.9, 1.0), ("good", 10.0, 11.0, 12.0, False, 0.75, 20.0),
         ("bad_r2", 10.0, 11.0, 12.0, False, 0.7499, 1.0),
         ("bad_mape", 10.0, 11.0, 12.0, False, 0.9, 20.01),
         ("nofit", 10.0, 11.0, 12.0, False, None, None)],
        "sku_id string, current_price double, new_price double, ai_optimal_price double, "
        "alert_flag boolean, elasticity_r2 double, elasticity_mape double")
    got = {r["sku_id"]: r["final_price"] for r in choose_price(df).collect()}
    assert got == {"alert": 10.0, "good": 12.0, "bad_r2": 11.0, "bad_mape": 11.0, "nofit": 11.0}


def test_modes_and_flags(spark):
    rows = master(spark, CASES)
    assert "ai_optimal_price" not in price(rows, "rule").columns
    assert "final_price" in price(rows, "hybrid", MODEL).columns
    with pytest.raises(ValueError):
        price(rows, "other")
    with pytest.raises(ValueError):
        price(rows, "ai")
    with pytest.raises(ValueError):
        price(rows, "ai", MODEL, PricingSettings(enabled=("rule",)))
    with pytest.raises(ValueError):
        price(rows.drop("demand_qty"), "rule")


def test_pricing_job_writes_and_compares(spark, tmp_path):
    rows = master(spark, CASES)
    folder = str(tmp_path / "priced")
    first = run_pricing(rows, "rule", folder, run=new_run("v1"))
    out = run_pricing(rows, "hybrid", folder, MODEL, champion=MODEL,
                      challenger=LinearDemand(200.0, price=-1.0), run=new_run("v2"))
    assert out["priced"].count() == len(CASES) == first["priced"].count()
    board = {r["metric"]: r["value"] for r in out["dashboard"].collect()}
    priced = out["priced"].toPandas()
    assert board["current_revenue"] == round((priced.current_price * priced.demand_qty).sum(), 2)
    assert board["chosen_revenue"] == round((priced.final_price * priced.demand_qty).sum(), 2)
    assert board["rule_revenue"] == round((priced.new_price * priced.demand_qty).sum(), 2)
    assert set(priced.pricing_strategy) >= {"AI optimized pricing", "Manual review (alert triggered)"}
    assert out["champion_challenger"].first()["champion_revenue"] > 0
    empty = first["champion_challenger"].first()
    assert empty["champion_revenue"] is None and empty["lift_pct"] is None
    assert set(priced.run_id) == {out["run"].run_id} and len(out["run"].run_id) == 6


def test_stored_fits_joined_equal_fits_in_the_row(spark):
    rows = spark.createDataFrame(
        [("a", 10.0, 5.0), ("b", 20.0, 0.0), ("c", 30.0, None), ("d", 12.5, 900.0), ("e", None, 4.0)],
        "sku_id string, current_price double, demand_qty double")
    names = ["sku_id", "slope", "intercept", "elasticity_r2", "elasticity_mae", "elasticity_mape"]
    own = elasticity.with_own_fit(rows).select(*names)
    stored = elasticity.fit(elasticity.base_point(rows))
    joined = elasticity.with_fit(rows, stored).select(*names)
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, own.collect()), key=repr)
    assert {r["sku_id"] for r in joined.where("slope IS NOT NULL").collect()} == {"a", "d"}
