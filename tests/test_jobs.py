"""Requests, revenue, registry, splits, metrics, text gap, stream and training."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators import evaluation, registry, requests as rq, revenue, textgap, training
from tagsmith.operators.demand_models import LinearDemand, MLlibDemand
from tagsmith.operators.features import event_counts, event_items
from tagsmith.operators.intents import train_intents
from tagsmith.operators.ordering import running_total
from tagsmith.operators.splits import random_split, time_split
from tagsmith.operators.sweep import sweep_prices
from tagsmith.plans.pricing import Run
from tagsmith.plans.request_pricing import price_requests
from tagsmith.plans.training import (
    TrainingSpec, champion_and_challenger, registered_model, train, train_and_register,
)
from tagsmith.streaming.web_events import (
    start_event_counts, start_window_counts, total_event_counts, total_window_counts,
)
from tagsmith.workload import roles as r

FEATURES = ("sku_id string, display_name string, list_price double, current_price double, "
            "total_inventory double, demand_qty double, competitor_price double, "
            "competitor_name string, all_competitors_json map<string,string>, "
            "ga4_views bigint, ga4_add_to_cart bigint")
MODEL = LinearDemand(300.0, price=-2.0)
RUN = Run("2024-01-01_000000", "v1", "R1")


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(
        [("sku-1", "mug", 100.0, 100.0, 60.0, 10.0, 99.0, "shop", {"shop": "99.0"}, 1, 0),
         ("sku-2", "cup", 100.0, 100.0, 10.0, 0.0, 50.0, "shop", None, 0, 0),
         ("SKU-3", "jar", 100.0, 100.0, 500.0, 3.0, None, None, None, 0, 0),
         ("sku-4", "pot", 100.0, 100.0, 500.0, 3.0, 0.0, None, None, 0, 0)], FEATURES)


def test_request_pricing(spark, features):
    asked = spark.createDataFrame(
        [(0, " sku-1 "), (1, "SKU-2"), (2, "SKU-3"), (3, "sku-3"), (4, "nope"), (5, ""),
         (6, "sku-1"), (7, "sku-4")], "pos int, sku_id string")
    out = price_requests(asked, features, MODEL, RUN)
    assert out["results"].columns == fv.RESULT_COLUMNS
    got = {x["sku_id"]: x for x in out["results"].collect()}
    assert set(got) == {"sku-1", "sku-2", "SKU-3", "sku-4"}
    assert sorted(x[0] for x in out["missing"].select("sku_id").collect()) == ["nope", "sku-3"]
    alert = got["sku-2"]
    assert (alert["alert_flag"], alert["pricing_reason"], alert["ai_strategy"]) == (
        True, "RULE_OVERRIDE_ALERT", "RULE_OVERRIDE")
    assert (alert["new_price"], alert["price_diff_pct"]) == (100.0, 100.0)
    mug = got["sku-1"]
    assert mug["pricing_reason"] == "AI_REVENUE_OPTIMIZED" and mug["new_price"] <= 99.0
    assert got["sku-4"]["competitor_bucket"] == "NO_COMPETITOR"
    assert got["sku-4"]["price_diff_pct"] == 0.0
    summary = out["summary"].first()
    assert (summary["requested"], summary["found"], summary["missing"], summary["status"]) == (
        6, 4, 2, "PARTIAL_SUCCESS")
    assert summary["summary"] == (
        "4 of 6 SKUs priced. 3 AI optimised, 1 rule overrides, 1 flagged for review.")


def test_request_status_ends(spark, features):
    def status(ids):
        asked = spark.createDataFrame(list(enumerate(ids)), "pos int, sku_id string")
        return price_requests(asked, features, MODEL, RUN)["summary"].first()["status"]

    assert status(["sku-1"]) == "SUCCESS"
    assert status(["none"]) == "FAILURE"


def test_exact_spelling_comes_first(spark, features):
    both = features.unionByName(features.filter("sku_id = 'sku-1'").withColumn(
        "sku_id", F.lit("SKU-1")))
    asked = spark.createDataFrame([(0, "SKU-1")], "pos int, sku_id string")
    assert [x["sku_id"] for x in rq.find_requested(asked, both).collect()] == ["SKU-1"]


# --- revenue --------------------------------------------------------------------------------------
def test_revenue_guards_and_sums(spark):
    df = spark.createDataFrame(
        [(10.0, 11.0, 12.0, 3.0), (0.0, 5.0, 5.0, 2.0), (4.0, 4.0, 3.0, 0.0)],
        "current_price double, new_price double, ai_optimal_price double, demand_qty double")
    per_row = revenue.revenue_impact(df.drop("ai_optimal_price")).collect()
    assert [x["revenue_change_pct"] for x in per_row] == [10.0, 0.0, 0.0]
    total = revenue.revenue_impact_summary(df).first()
    assert total["new_revenue"] == 46.0 and total["current_revenue"] == 30.0  # model price first
    lift = revenue.ai_vs_rule_summary(df).first()
    assert (lift["rule_revenue"], lift["revenue_lift"], lift["lift_pct"]) == (43.0, 3.0, 6.98)
    empty = revenue.current_vs_ai_summary(df.filter("current_price > 99")).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        revenue.revenue_impact(df.drop("demand_qty"))
    with pytest.raises(ValueError):
        revenue.revenue_impact(df.drop("new_price", "ai_optimal_price"))
    negative = revenue.revenue_lift(df.withColumn("current_price", F.lit(-1.0)), "current_price",
                                    "new_price", "demand_qty").first()
    assert negative["lift_pct"] == 0.0


# --- registry ----------------------------------------------------------------------------------------
def day(n):
    return datetime(2024, 1, n)


def test_registry_lifecycle(spark, tmp_path):
    table = None
    for n, (version, env) in enumerate([("v1", "dev"), ("v2", "dev"), ("v10", "dev"),
                                        ("v1", "prod")], 1):
        row = registry.new_version(spark, "xgboost", version, env, f"m/{env}{version}", day(n))
        path = str(tmp_path / f"registry_{n}")
        registry.save_version(path, "xgboost", env, row, table)
        table = spark.read.parquet(path)
    with pytest.raises(AnalysisException):
        registry.save_version(path, "xgboost", env, row, table)
    active = table.filter("is_active").groupBy("model_name", "environment").count().collect()
    assert len(active) == 2 and all(x["count"] == 1 for x in active)
    one = lambda **kw: registry.resolve_one(table, "xgboost", **kw)["model_version"]
    assert one() == "v10" and one(version="v10") == "v10"
    assert one(version="v1") == "v10"  # v1 is inactive, so the active one is taken
    assert one(environment="prod") == "v1"
    retired = table.withColumn("is_active", F.lit(False))
    assert registry.resolve_one(retired, "xgboost", version="v1")["model_version"] == "v10"
    with pytest.raises(ValueError):
        registry.resolve_one(table, "other")
    pair = {x["role"]: x["model_version"] for x in
            registry.champion_challenger(registry.versions(table, "xgboost", "dev")).collect()}
    assert pair == {"champion": "v10", "challenger": "v2"}
    dev = registry.versions(table, "xgboost", "dev")
    stages = lambda t: {x["model_version"]: x["stage"] for x in t.collect()}
    promoted = registry.promote_latest(dev)
    assert stages(promoted) == {"v1": "None", "v2": "None", "v10": "Production"}
    back = registry.rollback(promoted, "xgboost", "v2")
    assert stages(back) == {"v1": "None", "v2": "Production", "v10": "Archived"}
    assert stages(registry.transition(back, "xgboost", "v1", "Staging"))["v2"] == "Production"
    assert stages(registry.archive(back, "xgboost", "v2"))["v2"] == "Archived"
    assert "model_path" not in registry.metadata(table).columns


# --- order-dependent work ------------------------------------------------------------------------------
def test_running_total(spark):
    rng = np.random.default_rng(1)
    keys = rng.permutation(5000) * 3.0
    amounts = rng.integers(0, 9, 5000)
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "n": amounts}))
    got = running_total(df, "k", ["n"], parts=16).orderBy("k").toPandas()
    want = got["n"].cumsum() - got["n"]
    assert (got["n_before"] == want).all()


@pytest.mark.parametrize("hot", [False, True])
def test_time_split_cuts_exactly(spark, hot):
    """Also when more than a third of the rows share one instant at the cut."""
    rng = random.Random(4)
    dates = [day(20) if hot and rng.random() < 0.4 else day(rng.randint(1, 28)) for _ in range(999)]
    df = spark.createDataFrame(list(zip(range(999), dates)), "id bigint, at timestamp_ntz")
    before, after = time_split(df, "at", "id")
    ordered = sorted(zip(dates, range(999)))
    assert {x["id"] for x in after.collect()} == {i for _, i in ordered[999 - 166:]}
    assert before.count() == 999 - 166


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double"])
def test_time_split_in_another_time_zone(spark, kind):
    """The night clocks change: instants repeat or are missing in local time."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = 1730606400 if kind != "timestamp_ntz" else 1710050400
        seconds = spark.range(0, 600).select("id", (F.lit(base) + F.col("id") * 60).alias("s"))
        at = F.timestamp_seconds("s")
        at = {"timestamp": at, "date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 50).cast("int")),
              "double": F.col("id") / 7.0, "timestamp_ntz": F.expr(
                  "timestamp_ntz'2024-03-10 00:00:00' + make_interval(0,0,0,0,0,cast(id AS int),0)")
              }[kind]
        df = seconds.select("id", at.alias("at"))
        before, after = time_split(df, "at", "id", n_splits=2)
        assert sorted(x["id"] for x in after.collect()) == list(range(400, 600))
        assert before.count() == 400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_split_needs_dates(spark):
    df = spark.createDataFrame([(1, None), (2, day(2))] * 5, "id bigint, at timestamp_ntz")
    with pytest.raises(ValueError):
        time_split(df, "at", "id", 1)


def test_random_split_is_stable(spark):
    df = spark.range(20000)
    train_rows, test_rows = random_split(df, "id")
    assert train_rows.count() + test_rows.count() == 20000
    assert abs(test_rows.count() - 4000) < 200
    again = random_split(df.repartition(7), "id")[1]
    assert {x[0] for x in again.collect()} == {x[0] for x in test_rows.collect()}


# --- metrics ------------------------------------------------------------------------------------------
def test_regression_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.5, 2.0, 3.0, 9.0])
    df = spark.createDataFrame(pd.DataFrame({"actual": y, "predicted": p}))
    got = evaluation.regression_metrics(df).first()
    assert got["r2"] == round(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 6)
    assert got["mape"] == round(np.mean(abs((y - p) / (y + 1))) * 100, 6)
    assert got["pseudo_accuracy"] == round(100 - np.mean(abs(y - p) / y) * 100, 6)
    assert got["passes_gate"] is True
    flat = evaluation.regression_metrics(df.withColumn("actual", F.lit(3.0))).first()
    assert flat["r2"] == 0.0 and flat["passes_gate"] is False


def test_classification_metrics_with_a_hot_score(spark):
    rng = np.random.default_rng(2)
    n = 3000
    y = rng.integers(0, 2, n)
    score = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n) * 0.6 + y * 0.3, 2))
    guess = (score > 0.5).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"actual": y, "predicted": guess, "score": score}))
    got = evaluation.classification_metrics(df, score="score").first()
    pos, neg = score[y == 1], score[y == 0]
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    f1 = sum((y == c).mean() * 2 * ((y == c) & (guess == c)).sum()
             / ((y == c).sum() + (guess == c).sum()) for c in (0, 1))
    assert got["accuracy"] == round((y == guess).mean(), 6)
    assert abs(got["f1"] - f1) < 1e-6 and abs(got["roc_auc"] - area) < 1e-6
    assert "roc_auc" not in evaluation.classification_metrics(df).columns


# --- text gap -------------------------------------------------------------------------------------------
def test_gap_tables(spark, tmp_path):
    data = [(str(i), f"{w} {w} shoes", f"s{i % 2}", k, "v1", datetime(2024, 1, 1))
            for i in range(20) for w, k in (("red", "colour"), ("large", "size"))]
    bronze = spark.createDataFrame(
        data, "user_pseudo_id string, search_query string, sku string, "
        "standard_attribute_key string, model_version string, event_timestamp timestamp")
    model = train_intents(textgap.clean_queries(bronze))
    catalogue = spark.createDataFrame([("s0", "size"), ("s0", "size"), ("s1", "size"),
                                       ("s0", "colour")], "sku string, standard_attribute_key string")
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gaps")]
    textgap.write_gap_tables(bronze, model, catalogue, *paths)
    found = spark.read.parquet(paths[2])
    assert found.columns == fv.GAP_COLUMNS
    assert [tuple(x) for x in textgap.gap_counts(found).collect()] == [("colour", 10, 1)]
    assert spark.read.parquet(paths[1]).filter("confidence_score < 0.7").count() == 0


# --- stream ---------------------------------------------------------------------------------------------
def test_stream_totals_equal_batch(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    r.table(spark, sf, "events").repartition(4).write.parquet(source)
    stream = lambda: r.shape_events(spark.readStream.schema(r.SCHEMAS["events"])
                                    .option("maxFilesPerTrigger", 1).parquet(source))
    totals, mark = str(tmp_path / "totals"), str(tmp_path / "mark")
    for _ in range(2):  # the second start finds nothing new
        start_event_counts(stream(), totals, mark).awaitTermination()
    batch = sorted(map(tuple, event_counts(r.events(spark, sf)).collect()))
    got = total_event_counts(spark, totals)
    assert sorted(map(tuple, got.collect())) == batch
    # more events after a restart: the state goes on, the totals are read from one folder
    r.table(spark, sf, "events").write.mode("append").parquet(source)
    start_event_counts(stream(), totals, mark).awaitTermination()
    got = total_event_counts(spark, totals)
    assert sorted(map(tuple, got.collect())) == [(k, 2 * v, 2 * c) for k, v, c in batch]
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 2  # all that there is, however many batches
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and "PartitionFilters: [isnotnull(batch" in text


def test_windows_of_a_stream(spark, sf, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "windows", "mark"))
    r.table(spark, sf, "events").repartition(3).write.parquet(source)

    def run(**settings):
        raw = spark.readStream.schema(r.SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(source)
        start_window_counts(r.shape_events(raw), "ts", table, mark, "1 day", **settings).awaitTermination()
        return sorted(map(tuple, total_window_counts(spark, table).collect()), key=repr)

    items = event_items(r.events(spark, sf), keep=["ts"])
    batch = items.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("d"), "sku_id").agg(
        F.count_if(F.col("event_name") == "view_item"), F.count_if(F.col("event_name") == "add_to_cart"))
    want = sorted(map(tuple, batch.collect()), key=repr)
    assert run() == want
    # one late event changes its own window alone
    before = {f for f in spark.read.parquet(table).inputFiles()}
    first = r.table(spark, sf, "events").where("event_type = 'view'").orderBy("ts").limit(1)
    first.write.mode("append").parquet(source)
    again = run()
    assert sum(x[2] for x in again) == sum(x[2] for x in want) + 1 and len(again) == len(want)
    gone = before - {f for f in spark.read.parquet(table).inputFiles()}
    assert len({f.rsplit("/", 2)[1] for f in gone}) == 1


# --- training ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def golden(spark):
    rng = np.random.default_rng(9)
    n = 400
    price = rng.uniform(50, 150, n)
    rival = price * rng.uniform(0.8, 1.2, n)
    stock = rng.integers(0, 900, n).astype(float)
    gap = (price - rival) / rival * 100
    qty = 500 - 2.0 * price + 0.5 * rival + 0.05 * stock - 1.0 * gap
    return spark.createDataFrame(pd.DataFrame({
        "sku_id": [str(i) for i in range(n)], "price": price, "competitor_price": rival,
        "inventory_level": stock, "price_diff_pct": gap, "demand_qty": qty})).cache()


def test_linear_training_and_registry(spark, golden, tmp_path):
    path = str(tmp_path / "registry")
    out = train_and_register(golden, TrainingSpec("linear"), str(tmp_path / "models"), path, day(1))
    metrics = out["metrics"].first()
    assert metrics["r2"] > 0.999 and metrics["passes_gate"]
    assert np.allclose(out["model"].coefficients, [-2.0, 0.5, 0.05, -1.0], atol=1e-6)
    row = registry.resolve_one(spark.read.parquet(path), "linear")
    scored = PipelineModel.load(row["model_path"]).transform(golden)
    assert scored.filter(F.abs(F.col("prediction") - F.col("demand_qty")) > 1e-3).count() == 0
    assert out["importances"] == []


def test_pricing_with_registered_models(spark, golden, tmp_path):
    first, path, models = (str(tmp_path / n) for n in ("registry_1", "registry_2", "models"))
    with pytest.raises(ValueError, match="no row"):
        train_and_register(golden, TrainingSpec("linear"), models, first, day(1))
        registered_model(spark, first, "rf")
    assert champion_and_challenger(spark, first, "linear")[1] is None
    train_and_register(golden, TrainingSpec("linear", "v2.0", seed=7), models, path, day(2), spark.read.parquet(first))
    champion, challenger = champion_and_challenger(spark, path, "linear")
    assert isinstance(champion, LinearDemand) and champion != challenger
    latest = registered_model(spark, path, "linear")
    assert latest == champion
    features = tuple(F.col(c) for c in ("price", "competitor_price", "inventory_level",
                                        "price_diff_pct"))
    holes = golden.withColumn("inventory_level", F.when(F.col("sku_id") != "7", F.col("inventory_level")))
    scored = latest.score(holes, "demand", features)
    assert scored.count() == golden.count()
    assert [x["sku_id"] for x in scored.filter("demand is null").collect()] == ["7"]
    few = training.training_frame(golden, ["price", "inventory_level"])
    saved = training.as_pipeline(training.fit_model(few, "linear"), ["price", "inventory_level"])
    with pytest.raises(ValueError, match="need a model of"):
        MLlibDemand(saved)


def test_ml_sweep_equals_linear_expression(spark, golden):
    model = training.fit_model(training.training_frame(golden), "linear")
    rows = golden.select(
        "sku_id", F.col("price").alias("current_price"), "competitor_price",
        F.col("inventory_level").alias("total_inventory"), "price_diff_pct", "demand_qty",
        F.lit(False).alias("alert_flag"), F.lit(1.0).alias("new_price"))
    c = [float(v) for v in model.coefficients]
    same = LinearDemand(float(model.intercept), price=c[0], competitor=c[1], inventory=c[2], gap=c[3])
    pick = lambda m: sorted((x["sku_id"], x["ai_optimal_price"])
                            for x in sweep_prices(rows, m).collect())
    assert pick(MLlibDemand(model)) == pick(same)


def test_tree_models_and_search(golden):
    out = train(golden, TrainingSpec("rf", params={"n_estimators": 5, "max_depth": 4}))
    assert abs(sum(v for _, v in out["importances"]) - 1.0) < 1e-9
    frame = training.training_frame(golden, keep=("sku_id",)).cache()
    boosted = training.fit_model(frame, "xgboost", {"n_estimators": 3})
    assert boosted.getNumTrees == 3
    draw = lambda rng: {"n_estimators": rng.choice([2, 3]), "max_depth": rng.choice([2, 4])}
    _, best, trials = training.random_search(frame, "rf", "sku_id", draw, trials=2, folds=2)
    assert len(trials) == 2 and best == min(trials, key=lambda t: t[1])[0]
    _, _, grid = training.grid_search(frame, "rf", {"n_estimators": [2], "max_depth": [2, 4]},
                                      "sku_id", folds=2)
    assert [g for g, _ in grid] == [{"n_estimators": 2, "max_depth": 2},
                                    {"n_estimators": 2, "max_depth": 4}]
    tuned = train(golden, TrainingSpec("linear", trials=3))
    assert tuned["params"] == {}


def test_model_names_and_search_spaces():
    assert training.make_estimator("rf").getNumTrees() == 200
    boosted = training.make_estimator("xgboost")
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getMaxDepth()) == (300, 0.05, 5)
    leafy = training.make_estimator("rf", {"min_samples_split": 10, "min_samples_leaf": 2})
    assert leafy.getMinInstancesPerNode() == 5
    with pytest.raises(ValueError):
        training.make_estimator("other")
    a, b = (training.sample_boosted(random.Random(3)) for _ in range(2))
    assert a == b and 0.01 <= a["learning_rate"] <= 0.1 and a["n_estimators"] in (200, 300, 400)
    assert training.sample_forest(random.Random(1))["max_depth"] in (4, 6, 8, 10)
