"""Registered queries: each runs one operator over the whole benchmark tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tagsmith.functions.numeric import finite_or_zero, parse_number, round_to
from tagsmith.functions.text import clean_query, response_time_text, run_date_text
from tagsmith.operators import (
    boosting, elasticity, evaluation, golden, intents, quality, registry, revenue, splits, textgap, training,
)
from tagsmith.operators.demand_models import LinearDemand, predict_demand
from tagsmith.operators.features import (
    competitor_features, demand_signals, event_counts, event_counts_from_map,
    inventory_features, parse_offers, score_demand, sku_sales,
)
from tagsmith.operators.hybrid import choose_price
from tagsmith.operators.master import (
    dedup_skus, feature_table_info as table_info, last_row_per_sku, typed_features,
)
from tagsmith.operators.rules import batch_rules, service_rules
from tagsmith.operators.sweep import ai_output as with_ai, sweep_prices
from tagsmith.operators.tree_demand import demand_model, from_boosted
from tagsmith.plans.pricing import PricingSettings, Run, price, stamp
from tagsmith.plans.request_pricing import price_requests
from tagsmith.plans.training import (
    TrainingSpec, champion_and_challenger, registered_model, train, train_and_register,
)
from tagsmith.sources import feeds
from tagsmith.sources.columns import sanitize_names
from tagsmith.sources.tables import materialized, shared_folder
from tagsmith.streaming.web_events import (
    start_event_counts, total_event_counts, start_window_counts, total_window_counts,
)
from tagsmith.workload import roles as r, storage_queries  # noqa: F401  (registers its own)
from tagsmith.workload.catalog import query, registered  # noqa: F401

RUN = Run("2024-01-31_120000", "v1.0", "A1B2C3")
# --- feeds and aggregates -------------------------------------------------------------------
@query
def sku_sales_(spark, sf):
    return sku_sales(r.orders(spark, sf))


@query
def ga4_signal_counts(spark, sf):
    return event_counts(r.events(spark, sf))


@query
def ga4_preagg_counts(spark, sf):
    return event_counts_from_map(r.event_count_maps(spark, sf))


@query
def inventory_totals(spark, sf):
    return inventory_features(r.inventory(spark, sf))


@query
def demand_score(spark, sf):
    return score_demand(demand_signals(sku_sales(r.orders(spark, sf)),
                                       event_counts(r.events(spark, sf))))


@query
def lowest_competitor(spark, sf):
    return parse_offers(r.competitor_feed(spark, sf)).select(
        "sku_id", "competitor_price", "competitor_name")


@query
def competitor_map(spark, sf):
    return parse_offers(r.competitor_feed(spark, sf)).select(
        "sku_id", F.to_json("all_competitors").alias("all_competitors_json"))


@query
def competitor_position(spark, sf):
    return competitor_features(r.competitor_feed_by_name(spark, sf), r.sku(spark, sf),
                               r.price(spark, sf))


@query
def master_dataset(spark, sf):
    return r.master(spark, sf)


@query
def master_dataset_batch(spark, sf):
    return r.master(spark, sf, "batch")


@query
def sku_dedup(spark, sf):
    priced = r.price(spark, sf).select("sku_id", F.col("list_price").alias("current_price"))
    return dedup_skus(priced, r.sku(spark, sf))


@query
def last_line_per_sku(spark, sf):
    lines = r.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("sku_id"), "l_quantity",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"))
    totals = lines.groupBy("sku_id", "line_no").agg(F.sum("l_quantity").alias("quantity"))
    return last_row_per_sku(totals, "line_no")


# --- cleaning -------------------------------------------------------------------------------
def _golden_raw(spark, sf):
    return golden.master_to_golden(r.master(spark, sf), r.orders(spark, sf))


@query
def null_report(spark, sf):
    raw = _golden_raw(spark, sf)
    quality.require_columns(raw, raw.columns)
    return quality.null_report(raw, raw.columns)


@query
def golden_clean(spark, sf):
    raw = _golden_raw(spark, sf)
    return quality.clean_golden(raw, raw.columns)


@query
def golden_pricing_frame(spark, sf):
    raw = _golden_raw(spark, sf)
    return golden.golden_to_pricing(quality.clean_golden(raw, raw.columns)).drop(
        "competitor_name")


@query
def alias_columns(spark, sf):
    part = r.table(spark, sf, "part")
    names = feeds.sku_names(part.select(
        F.col("p_partkey").alias(" Item_ID"), F.col("p_name").alias("Title ")))
    prices = feeds.prices(part.select(
        F.col("p_partkey").alias("SKU_Code"), F.col("p_retailprice").cast("string").alias(" MRP"),
        (F.col("p_retailprice") * F.col("p_size")).cast("string").alias("Sale_Price "),
        F.col("p_size").alias("SKU_CODE ")))
    joined = names.join(prices, "sku_id", "inner")
    return sanitize_names(joined.withColumnRenamed("list_price", "list price (base)"))


@query
def numeric_coercion(spark, sf):
    part = r.table(spark, sf, "part")
    kind = F.col("p_partkey") % 8
    written = (F.when(kind == 0, "1,299").when(kind == 1, "").when(kind == 2, "nan")
               .when(kind == 3, "inf").when(kind == 4, F.concat(F.lit(" "), F.col("p_size")))
               .when(kind == 5, "abc").otherwise(F.col("p_retailprice").cast("string")))
    special = (F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf")))
               .when(kind == 2, F.lit(float("-inf"))).otherwise(F.col("p_retailprice")))
    return part.select("p_partkey", parse_number(written).alias("parsed"),
                       finite_or_zero(special).alias("cleaned"))


@query
def date_texts(spark, sf):
    return r.table(spark, sf, "events").select(
        "event_id", run_date_text(F.col("ts")).alias("run_date"),
        response_time_text(F.col("ts")).alias("response_time"))


@query
def clean_requests(spark, sf):
    return quality.clean_request_ids(r.requests(spark, sf))


# --- prices -------------------------------------------------------------------------------------
_RULE = ["sku_id", "current_price", "competitor_price", "price_diff_pct", "new_price",
         "decision_reason", "alert_flag"]
_AI = ["sku_id", "current_price", "new_price", "ai_optimal_price", "pricing_reason",
       "ai_strategy", "price_change_pct"]


@query
def price_rules_batch(spark, sf):
    return batch_rules(r.master(spark, sf)).select(*_RULE)


@query
def price_rules_service(spark, sf):
    return service_rules(r.master(spark, sf)).select(*_RULE, "pricing_reason")


def _fits(spark, sf):
    rows = elasticity.training_rows(r.master(spark, sf), r.orders(spark, sf))
    return elasticity.fit(elasticity.base_point(rows))


@query
def elasticity_training_rows(spark, sf):
    return elasticity.training_rows(r.master(spark, sf), r.orders(spark, sf))


@query
def elasticity_fit(spark, sf):
    return _fits(spark, sf).select(
        "sku_id", "base_price", "base_demand", round_to(F.col("slope"), 6).alias("slope"),
        round_to(F.col("intercept"), 3).alias("intercept"), "elasticity_r2", "elasticity_mae",
        "elasticity_mape")


@query
def elasticity_price(spark, sf):
    """The fit in the row of the master, which has one row per SKU and its sales."""
    return elasticity.optimal_price(
        elasticity.with_own_fit(r.master_with_sales(spark, sf))).select(
        "sku_id", "current_price", "elasticity_price")


@query
def price_sweep_linear(spark, sf):
    """Sweep on each SKU's own demand line."""
    rows = elasticity.with_own_fit(_ruled(spark, sf))
    return sweep_prices(rows, LinearDemand("intercept", price="slope")).select(
        "sku_id", "current_price", "ai_optimal_price", "pricing_reason")


def _ruled(spark, sf):
    return batch_rules(r.master_with_sales(spark, sf))


@query
def ai_output(spark, sf):
    return with_ai(_ruled(spark, sf), r.CHAMPION).select(*_AI)


@query
def ai_output_rejections(spark, sf):
    """A negative tolerance asks for a minimum gain and rejects the rest."""
    return with_ai(_ruled(spark, sf), r.CHAMPION, tolerance=-0.5).select(*_AI)


@query
def hybrid_price(spark, sf):
    swept = with_ai(elasticity.with_own_fit(_ruled(spark, sf)), r.CHAMPION)
    return choose_price(swept, max_mape=2.9).select(
        "sku_id", "new_price", "ai_optimal_price", "elasticity_r2", "elasticity_mape",
        "final_price", "pricing_strategy")


@query
def priced_output_stamped(spark, sf):
    settings = PricingSettings(max_mape=2.9)
    priced = price(r.master_with_sales(spark, sf), "hybrid", r.CHAMPION, settings)
    return stamp(priced, RUN).select(
        "sku_id", "final_price", "pricing_strategy", "run_date", "model_version", "run_id")


@query
def predicted_demand(spark, sf):
    return predict_demand(r.master(spark, sf), r.CHAMPION).select(
        "sku_id", "current_price", "predicted_demand")


# --- requests ---------------------------------------------------------------------------------
def _answers(spark, sf):
    return price_requests(r.requests(spark, sf), r.published(spark, sf), r.CHAMPION, RUN)


@query
def request_pricing(spark, sf):
    rows = _answers(spark, sf)["results"]
    return rows.withColumn("all_competitors_json", F.to_json("all_competitors_json"))


@query
def missing_requests(spark, sf):
    return _answers(spark, sf)["missing"]


@query
def request_summary(spark, sf):
    return _answers(spark, sf)["summary"]


@query
def published_features(spark, sf):
    rows = typed_features(r.master(spark, sf))
    return rows.withColumn("all_competitors_json", F.to_json("all_competitors_json"))


@query
def feature_table_info(spark, sf):
    return table_info(r.features(spark, sf))


# --- revenue ------------------------------------------------------------------------------------
@query
def revenue_rows(spark, sf):
    return revenue.revenue_impact(_ruled(spark, sf)).select(
        "sku_id", "current_revenue", "simulated_revenue", "revenue_change",
        "revenue_change_pct")


@query
def revenue_current_vs_new(spark, sf):
    return revenue.revenue_impact_summary(_ruled(spark, sf))


@query
def revenue_current_vs_ai(spark, sf):
    return revenue.current_vs_ai_summary(with_ai(_ruled(spark, sf), r.CHAMPION))


@query
def revenue_ai_vs_rule(spark, sf):
    return revenue.ai_vs_rule_summary(with_ai(_ruled(spark, sf), r.CHAMPION))


@query
def revenue_ai_vs_rule_rows(spark, sf):
    return revenue.ai_vs_rule(with_ai(_ruled(spark, sf), r.CHAMPION)).select(
        "sku_id", "rule_revenue", "ai_revenue", "revenue_lift", "revenue_lift_pct")


@query
def revenue_lift(spark, sf):
    return revenue.revenue_lift(_ruled(spark, sf), "current_price", "new_price", "demand_qty")


def _paired(spark, sf):
    return revenue.score_champion_challenger(r.master_with_sales(spark, sf), r.CHAMPION,
                                             r.CHALLENGER)


@query
def champion_challenger_rows(spark, sf):
    return _paired(spark, sf).select("sku_id", "champion_demand", "challenger_demand",
                                     "champion_revenue", "challenger_revenue")


@query
def champion_vs_challenger(spark, sf):
    totals = revenue.champion_challenger_summary(_paired(spark, sf))
    return totals.select(*[round_to(F.col(c), 4).alias(c) for c in totals.columns])


@query
def strategy_dashboard(spark, sf):
    priced = with_ai(_ruled(spark, sf), r.CHAMPION)
    return revenue.strategy_dashboard(
        revenue.score_champion_challenger(priced, r.CHAMPION, r.CHALLENGER))


# --- splits and metrics ----------------------------------------------------------------------
@query
def hash_split(spark, sf):
    orders = r.table(spark, sf, "orders").select("o_orderkey")
    return orders.withColumn("in_test", splits.in_test_part(F.col("o_orderkey")))


@query
def time_split(spark, sf):
    orders = r.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    train_rows, test_rows = splits.time_split(orders, "o_orderdate", "o_orderkey")
    return train_rows.withColumn("part", F.lit("train")).unionByName(
        test_rows.withColumn("part", F.lit("test")))


@query
def regression_metrics(spark, sf):
    rows = r.master_with_sales(spark, sf).select(
        F.col("demand_qty").alias("actual"),
        (F.col("total_inventory") * 0.4 + 500.0).alias("predicted"))
    return evaluation.regression_metrics(rows)


def _judged_documents(spark, sf):
    docs = r.table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = r.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("actual"))
    score = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return labels.join(docs, "doc_id", "inner").select(
        "actual", (F.col("n_chars") >= 1000).cast("int").alias("predicted"),
        score.alias("score"))


@query
def classification_metrics(spark, sf):
    return evaluation.classification_metrics(_judged_documents(spark, sf), score="score")


# --- registry ------------------------------------------------------------------------------------
@query
def registry_register(spark, sf):
    table = r.registry(spark, sf)
    newest = table.agg(F.max("created_at").alias("created_at")).select(
        F.lit("1-URGENT").alias("model_name"), F.lit("v999999999").alias("model_version"),
        F.lit("F").alias("environment"), F.lit("models/new").alias("model_path"),
        F.lit("[]").alias("feature_columns"), "created_at", F.lit(True).alias("is_active"),
        F.lit("None").alias("stage"))
    return registry.register(table, "1-URGENT", "F", newest)


@query
def registry_resolve(spark, sf):
    return registry.resolve(r.registry(spark, sf), "v100")


@query
def registry_resolve_latest(spark, sf):
    return registry.metadata(registry.resolve(r.registry(spark, sf)))


@query
def registry_champion(spark, sf):
    return registry.champion_challenger(r.registry(spark, sf))


@query
def registry_promote(spark, sf):
    return registry.promote_latest(r.registry(spark, sf))


@query
def registry_rollback(spark, sf):
    return registry.rollback(r.registry(spark, sf), "2-HIGH", "v10")


# --- text gap ---------------------------------------------------------------------------------
@query
def query_text_clean(spark, sf):
    return r.search_queries(spark, sf).select(
        "user_pseudo_id", clean_query(F.col("search_query")).alias("search_query"))


def _gaps(spark, sf):
    return textgap.gaps(textgap.confident(r.scored_queries(spark, sf)),
                        r.sku_attributes(spark, sf))


@query
def gap_rows(spark, sf):
    return _gaps(spark, sf)


@query
def gap_counts(spark, sf):
    return textgap.gap_counts(_gaps(spark, sf))


# --- stream --------------------------------------------------------------------------------------
@query
def stream_ga4_counts(spark, sf):
    """All events through the stream in available-now mode, then the totals."""
    stream = spark.readStream.schema(r.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    base = f"{shared_folder(spark)}/event_counts_{uuid.uuid4().hex}"
    run = start_event_counts(r.shape_events(stream), f"{base}/totals", f"{base}/checkpoint")
    run.awaitTermination()
    return total_event_counts(spark, f"{base}/totals")


@query
def stream_ga4_windows(spark, sf):
    """Hourly windows per SKU, the open ones included."""
    stream = spark.readStream.schema(r.SCHEMAS["events"]).option(
        "pathGlobFilter", "events.parquet").parquet(sf)
    base = f"{shared_folder(spark)}/event_windows_{uuid.uuid4().hex}"
    start_window_counts(r.shape_events(stream), "ts", f"{base}/windows",
                        f"{base}/checkpoint").awaitTermination()
    windows = total_window_counts(spark, f"{base}/windows")
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


# --- model training ---------------------------------------------------------------------------
def _train(spark, sf, name, params=None):
    spec = TrainingSpec(model_name=name, params=params or {})
    return train(materialized(_golden_raw(spark, sf), "golden"), spec)


@query
def train_linear(spark, sf):
    return _train(spark, sf, "linear")["metrics"]


@query
def actual_vs_predicted(spark, sf):
    scored = _train(spark, sf, "linear")["scored"]
    return scored.withColumn("predicted", round_to(F.col("predicted"), 4))


def _facts(out):
    """What holds for any model that has learnt: all rows used, all scores finite, and a smaller
    error on its training rows than the mean."""
    fitted = out["model"].transform(out["rows"])
    mean = fitted.agg(F.avg("label").alias("mean")).scalar()
    learnt = fitted.withColumn("mean", mean).agg(
        F.count(F.lit(1)).alias("train_rows"),
        (F.avg(F.abs(F.col("label") - F.col("prediction")))
         < F.avg(F.abs(F.col("label") - F.col("mean")))).alias("closer_than_mean"))
    tested = out["scored"].withColumn("mean", mean).agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.abs("predicted") < float("inf")).alias("finite_scores"),
        round_to(F.avg(F.abs(F.col("actual") - F.col("mean"))), 6).alias("mean_model_mae"))
    return learnt.select("*", *[tested.select(c).scalar().alias(c) for c in tested.columns])


@query
def train_rf(spark, sf):
    return _facts(_train(spark, sf, "rf"))


@query
def train_gbt(spark, sf):
    return _facts(_train(spark, sf, "xgboost"))


def _leafwise(spark, sf):
    """Three rounds of leaf-wise trees of default size over all golden rows."""
    raw = _golden_raw(spark, sf)
    rows = materialized(quality.clean_golden(raw, raw.columns), "golden")
    return boosting.fit_boosted(rows, params=boosting.BoostingParams(n_estimators=3)), rows


@query
def train_leafwise(spark, sf):
    """Every split and leaf of the trees."""
    model, _ = _leafwise(spark, sf)
    return model.nodes(spark)


@query
def leafwise_demand(spark, sf):
    """The trees' demand for every row, scored inside the row."""
    model, rows = _leafwise(spark, sf)
    scored = from_boosted(model).score(rows, "predicted", tuple(F.col(c) for c in model.features))
    return scored.select("sku_id", F.col("demand_qty").alias("actual"), "predicted")


@query
def leafwise_importances(spark, sf):
    """Every feature's share of what all splits have gained."""
    model, _ = _leafwise(spark, sf)
    rows = [(c, share) for c, share in training.feature_importances(model)]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.withColumn("importance", round_to(F.col("importance"), 9))


@query
def tune_leafwise(spark, sf):
    """Every point of a grid with its cross-validated error; one fit a fold serves all numbers of rounds."""
    grid = {"num_leaves": [4, 8], "n_estimators": [1, 2, 3]}
    _, best, trials = training.grid_search(_frame(spark, sf), "lightgbm", grid, "sku_id")
    rows = [(p["num_leaves"], p["n_estimators"], mae, p == best) for p, mae in trials]
    frame = spark.createDataFrame(rows, "num_leaves bigint, n_estimators bigint, mae double, is_best boolean")
    return frame.withColumn("mae", round_to(F.col("mae"), 6))


def _frame(spark, sf):
    raw = _golden_raw(spark, sf)
    rows = training.training_frame(quality.clean_golden(raw, raw.columns), keep=("sku_id",))
    return materialized(rows, "training_rows")


def _search_facts(spark, found, space):
    """Trials made, whether all drew from the space, and whether the best one was taken."""
    _, best, trials = found
    inside = all(set(p) == set(space) and all(p[k] in space[k] for k in p) for p, _ in trials)
    least = min(mae for _, mae in trials)
    row = (len(trials), inside, any(p == best and mae == least for p, mae in trials))
    return spark.createDataFrame([row], "trials bigint, in_space boolean, best_is_least boolean")


@query
def tune_random(spark, sf):
    """The default number of draws from the forest's own search space."""
    space = {"n_estimators": [100, 200, 300, 400], "max_depth": [4, 6, 8, 10],
             "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
             "max_features": ["sqrt", "log2"]}
    return _search_facts(spark, training.random_search(_frame(spark, sf), "rf", "sku_id"), space)


@query
def tune_grid(spark, sf):
    space = {"n_estimators": [100, 200], "max_depth": [4, 6]}
    return _search_facts(
        spark, training.grid_search(_frame(spark, sf), "rf", space, "sku_id"), space)


@query
def feature_importances(spark, sf):
    """Importances of a forest are shares: one per feature, none negative, one in total."""
    out = _train(spark, sf, "rf")
    rows = spark.createDataFrame(out["importances"], "feature string, importance double")
    return rows.agg(F.count_distinct("feature").alias("features"),
                    F.count_if(F.col("importance") >= 0).alias("shares"),
                    round_to(F.sum("importance"), 6).alias("total"))


@query
def sweep_mllib(spark, sf):
    model = training.fit_model(_frame(spark, sf), "linear")
    return with_ai(_ruled(spark, sf), demand_model(spark, model)).select(*_AI)


@query
def registered_model_price(spark, sf):
    """A model trained and registered, resolved from the registry, loaded, and priced with."""
    base = f"{shared_folder(spark)}/models_{uuid.uuid4().hex}"
    train_and_register(materialized(_golden_raw(spark, sf), "golden"), TrainingSpec("linear"),
                       f"{base}/models", f"{base}/registry", datetime(2024, 1, 1))
    model = registered_model(spark, f"{base}/registry", "linear")
    return with_ai(_ruled(spark, sf), model).select(*_AI)


@query
def registered_champions(spark, sf):
    """Two versions trained and registered; the newest and the one before it, compared on every SKU."""
    base = f"{shared_folder(spark)}/models_{uuid.uuid4().hex}"
    rows = materialized(_golden_raw(spark, sf), "golden")
    train_and_register(rows, TrainingSpec("linear"), f"{base}/models", f"{base}/1", datetime(2024, 1, 1))
    train_and_register(rows, TrainingSpec("linear", "v2.0", seed=7), f"{base}/models", f"{base}/2",
                       datetime(2024, 1, 2), spark.read.parquet(f"{base}/1"))
    pair = champion_and_challenger(spark, f"{base}/2", "linear")
    scored = revenue.score_champion_challenger(r.master_with_sales(spark, sf), *pair)
    return scored.select("sku_id", *[round_to(F.col(f"{who}_demand"), 4).alias(f"{who}_demand")
                                     for who in ("champion", "challenger")],
                         *[round_to(F.col(f"{who}_revenue"), 2).alias(f"{who}_revenue")
                           for who in ("champion", "challenger")])


@query
def intent_classifier(spark, sf):
    """Every search text classified by a model of all of them."""
    texts = materialized(textgap.clean_queries(r.search_queries(spark, sf)), "queries")
    found = intents.predict_intents(intents.train_intents(texts), texts)
    return found.select("user_pseudo_id", "standard_attribute_key",
                        round_to(F.col("confidence_score"), 6).alias("confidence_score"))


@query
def gap_chain(spark, sf):
    """Clean, classify, keep the confident, write the three tables, find the gaps: the model is trained on
    every second text, so not every text gets its own attribute."""
    base = f"{shared_folder(spark)}/gaps_{uuid.uuid4().hex}"
    received = r.scored_queries(spark, sf).drop("confidence_score")
    known = received.where(F.col("user_pseudo_id").cast("bigint") % 2 == 0)
    model = intents.train_intents(materialized(textgap.clean_queries(known), "queries"))
    paths = [f"{base}/{n}" for n in ("bronze", "silver", "gaps")]
    textgap.write_gap_tables(received, model, r.sku_attributes(spark, sf), *paths)
    return spark.read.parquet(paths[2]).withColumn(
        "confidence_score", round_to(F.col("confidence_score"), 6))


# --- flagship ---------------------------------------------------------------------------------
@query
def rule_outcomes(spark, sf):
    """SKUs and revenue at current and at rule prices, per rule that fired."""
    priced = batch_rules(r.master_with_sales(spark, sf))
    rows = revenue.revenue_impact(priced)
    return rows.groupBy("decision_reason").agg(
        F.count(F.lit(1)).alias("skus"),
        round_to(revenue.exact_total(F.col("current_revenue")), 2).alias("current_revenue"),
        round_to(revenue.exact_total(F.col("simulated_revenue")), 2).alias("new_revenue"))
