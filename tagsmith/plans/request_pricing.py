"""Pricing of a list of requested SKUs against the published feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators.quality import clean_request_ids
from tagsmith.operators.requests import (
    find_requested, not_found, pricing_frame, result_rows, run_summary,
)
from tagsmith.operators.rules import service_rules
from tagsmith.operators.sweep import ai_output
from tagsmith.plans.pricing import Run
from tagsmith.operators.features import ITEM_KEYS, with_texts
from tagsmith.operators.master import competitor_map, master_and_texts, typed_features
from tagsmith.sources.tables import publish_table


def price_requests(requests: DataFrame, features: DataFrame, model, run: Run,
                   tolerance: float = fv.TOLERANCE) -> dict[str, DataFrame]:
    """Result rows, missing ids and the one-row summary, all lazy."""
    wanted = clean_request_ids(requests)
    found = find_requested(wanted, features)
    priced = ai_output(service_rules(pricing_frame(found)), model, "service", tolerance)
    results = result_rows(priced, run.run_date, run.run_id, run.model_version)
    return {"results": results, "missing": not_found(wanted, found),
            "summary": run_summary(wanted, results)}


def publish_features(feeds: dict[str, DataFrame], counts: DataFrame, name: str, folder: str,
                     signals: DataFrame | None = None, buckets: int | None = None) -> None:
    """Rebuild the feature table from the feeds and publish it as the version `name`, laid out for
    lookups by SKU.

    The shops of a product are one row in a table beside it (`<name>_items`, in `<folder>_items`), which
    comes first: beside each of the product's SKUs the list would be far larger than the feeds.
    """
    rows, texts = master_and_texts(feeds["price"], feeds["sku"], feeds["orders"], feeds["inventory"],
                                   counts, feeds["competitors"], "service")
    items = texts.select("_item", "_copies", competitor_map())
    items.write.option("path", f"{folder}_items").mode("errorifexists").saveAsTable(f"{name}_items")
    publish_table(typed_features(rows, signals), name, folder, "sku_id", buckets)


def reload_features(spark: SparkSession, name: str, as_text: bool = False) -> DataFrame:
    """A published version of the feature table, the map of its shops in each row; `as_text` gives the map
    as JSON, written once a product and not in every row.

    `spark.table(name)` is the table as it lies there: a lookup of many SKUs takes its rows from there and
    then their maps by `with_shops`.
    """
    return with_shops(spark.table(name), name, as_text)


def with_shops(rows: DataFrame, name: str, as_text: bool = False) -> DataFrame:
    """Rows of the published version `name` with the map of their shops where the table names their item."""
    shops = "all_competitors_json"
    text = F.to_json(shops).alias(shops)
    if shops in rows.columns:  # published row by row
        return rows.withColumn(shops, text) if as_text else rows
    items = rows.sparkSession.table(f"{name}_items").select("_item", "_copies", text if as_text else shops)
    order = [shops if c == ITEM_KEYS[0] else c for c in rows.columns if c not in ITEM_KEYS[1:]]
    return with_texts(rows, items).select(*order)
