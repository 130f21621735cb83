"""Pricing of requested SKUs: lookup, missing ids, result rows and the run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.functions.labels import (
    confidence_label, confidence_score, result_competitor_label, result_demand_label,
    result_stock_label,
)
from tagsmith.functions.numeric import pct_change, ratio, real, round_to
from tagsmith.operators.features import first_per_key

NOT_FOUND = "SKU not found in feature store"


def find_requested(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows of the requested ids, by exact id or else by lower-cased id.

    Each request offers one or two candidate ids and one join serves both, so a short request
    list is broadcast (when Spark measures it as small) and the feature table is never
    shuffled. `requested_id` and `pos` tell which request a row answers.
    """
    asked = F.col("sku_id")
    spellings = F.array_distinct(F.array(asked, F.lower(asked)))
    candidates = requests.select(
        asked.alias("requested_id"), "pos", F.posexplode(spellings).alias("_choice", "sku_id"))
    found = candidates.join(features, "sku_id", "inner")
    return first_per_key(found, ["requested_id"], [F.col("_choice")]).drop("_choice")


def find_ids(features: DataFrame, ids: list[str]) -> DataFrame:
    """Feature rows of a short list of ids, as one request names them. The ids stand in the plan, so of a
    table bucketed by SKU only their buckets are read."""
    if len(ids) > fv.MAX_REQUESTED_IDS:
        raise ValueError(f"a request names at most {fv.MAX_REQUESTED_IDS} ids, not {len(ids)}")
    wanted = list(dict.fromkeys(x.strip() for x in ids if x.strip()))
    spellings = list(dict.fromkeys([*wanted, *(x.lower() for x in wanted)]))
    rows = features.where(F.col("sku_id").isin(spellings))
    requests = features.sparkSession.createDataFrame(list(enumerate(wanted)), "pos bigint, sku_id string")
    return find_requested(requests, rows)


def missing_requests(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Requested ids that match no feature row in either spelling."""
    return not_found(requests, find_requested(requests, features.select("sku_id")))


def not_found(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Requested ids that a lookup has not answered."""
    answered = found.select("requested_id")
    missing = requests.join(answered, requests["sku_id"] == answered["requested_id"], "left_anti")
    return missing.select("sku_id", F.lit(NOT_FOUND).alias("error"))


def pricing_frame(found: DataFrame) -> DataFrame:
    """Rows as the rules expect them: only positive competitor prices, gap recomputed."""
    rival = real(F.col("competitor_price"))
    usable = F.when(rival > 0, rival)
    gap = F.coalesce(ratio(F.col("list_price") - usable, usable) * 100.0, F.lit(0.0))
    return found.withColumns({
        "competitor_price": usable,
        "price_diff_pct": round_to(gap, 2),
        "demand_qty": F.coalesce(real(F.col("demand_qty")), F.lit(0.0)),
    })


def result_rows(priced: DataFrame, run_date: str, run_id: str, model_version: str) -> DataFrame:
    """The 25 result columns, rounded, with result bands, confidence and run stamps.

    Run stamps are one literal per run, so a retried task writes the same rows.
    """
    current, new = F.col("current_price"), F.col("ai_optimal_price")
    change = F.when(current > 0, round_to(pct_change(new, current), 2)).otherwise(F.lit(0.0))
    rows = priced.withColumn("price_change_pct", change)
    score = confidence_score(F.col("competitor_price"), F.col("total_inventory"),
                             F.col("demand_qty"), F.col("ga4_views"), F.col("ga4_add_to_cart"),
                             F.col("price_change_pct"))
    rows = rows.withColumn("confidence_score", score)
    computed = {
        "competitor_bucket": result_competitor_label(current, F.col("competitor_price")),
        "price_diff_pct": round_to(F.col("price_diff_pct"), 2),
        "inventory_bucket": result_stock_label(F.col("total_inventory")),
        "demand_qty": round_to(F.col("demand_qty"), 4),
        "demand_bucket": result_demand_label(F.col("demand_qty")),
        "new_price": round_to(new, 2),
        "ai_optimal_price": round_to(new, 2),
        "confidence_label": confidence_label(F.col("confidence_score")),
        "run_date": F.lit(run_date),
        "run_id": F.lit(run_id),
        "model_version": F.lit(model_version),
    }
    return rows.select(*[
        computed[c].alias(c) if c in computed else F.col(c) for c in fv.RESULT_COLUMNS])


def run_summary(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One row: counts, status and the summary sentence. Every requested id is either a result
    or missing."""
    asked = requests.agg(F.count(F.lit(1)).alias("requested")).scalar()
    counts = results.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("ai_strategy") == "AI_OPTIMISED").alias("ai_optimised"),
        F.count_if(F.col("ai_strategy") == "RULE_OVERRIDE").alias("rule_overrides"),
        F.count_if("alert_flag").alias("alerts"))
    counts = counts.withColumn("requested", asked).select(
        "requested", "found", (F.col("requested") - F.col("found")).alias("missing"),
        "ai_optimised", "rule_overrides", "alerts")
    status = (F.when(F.col("missing") == 0, "SUCCESS")
              .when(F.col("found") > 0, "PARTIAL_SUCCESS").otherwise("FAILURE"))
    sentence = F.format_string(
        "%d of %d SKUs priced. %d AI optimised, %d rule overrides, %d flagged for review.",
        "found", "requested", "ai_optimised", "rule_overrides", "alerts")
    return counts.withColumns({"status": status, "summary": sentence})
