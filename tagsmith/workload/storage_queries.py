"""Registered queries that go through files: whole tables written by Spark, read by the library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagsmith.operators import golden, quality, registry
from tagsmith.operators.features import (
    event_counts, event_counts_from_map, inventory_features, parse_offers, sku_sales,
)
from tagsmith.operators.master import build_master, master_from_feeds
from tagsmith.plans.pricing import PricingSettings, Run, run_pricing
from tagsmith.plans.request_pricing import publish_features, reload_features
from tagsmith.sources import feeds, tables
from tagsmith.workload import roles as r
from tagsmith.workload.catalog import query


def _folder(spark) -> str:
    return f"{tables.shared_folder(spark)}/files_{uuid.uuid4().hex}"


def _csv(df, path: str) -> str:
    df.write.csv(path, header=True)
    return path


def _write_sku(spark, sf, folder):
    part = r.table(spark, sf, "part")
    return _csv(part.select(F.col("p_partkey").alias("Product_ID"), F.col("p_name").alias("Title")),
                f"{folder}/sku.csv")


def _write_price(spark, sf, folder):
    part = r.table(spark, sf, "part")
    return _csv(part.select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("MRP")),
                f"{folder}/price.csv")


def _write_orders(spark, sf, folder):
    lines = r.table(spark, sf, "lineitem")
    return _csv(lines.select(F.col("l_partkey").alias("catalog_ref_id"),
                             F.col("l_quantity").alias("Qty")), f"{folder}/purchased_order.csv")


def _write_inventory(spark, sf, folder):
    return _csv(r.inventory(spark, sf).select(
        F.col("sku_id").alias("catalog_ref_id"), F.col("stock").alias("stock_level")),
        f"{folder}/inventory.csv")


def _write_events(spark, sf, folder):
    path = f"{folder}/ga4_events.json"
    r.events(spark, sf).drop("ts").write.json(path)
    return path


def _write_competitors(spark, sf, folder):
    path = f"{folder}/competitor_pricing.json"
    r.competitor_feed_by_name(spark, sf).select("name", "summary").write.json(path)
    return path


@query
def sku_csv_feed(spark, sf):
    return feeds.load_sku(spark, _write_sku(spark, sf, _folder(spark)))


@query
def sku_csv_feed_batch(spark, sf):
    part = r.table(spark, sf, "part").select("p_partkey", "p_name")
    path = _csv(part.toDF("SKU_ID", " Display_Name"), f"{_folder(spark)}/sku.csv")
    return feeds.load_sku(spark, path, "batch")


@query
def orders_csv_feed_batch(spark, sf):
    lines = r.table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    path = _csv(lines.toDF("Catalog_Ref_ID", "QTY"), f"{_folder(spark)}/purchased_order.csv")
    return sku_sales(feeds.load_orders(spark, path, "batch"))


@query
def price_csv_feed_gaps(spark, sf):
    """Current prices that are absent or zero: the list price stands in for them."""
    key, listed = F.col("p_partkey"), F.col("p_retailprice")
    current = F.when(key % 3 == 1, 0.0).when(key % 3 == 2, listed * 0.9)
    part = r.table(spark, sf, "part").select(
        key.alias("sku_id"), listed.alias("list_price"), current.alias("Current_Price"))
    path = _csv(part, f"{_folder(spark)}/price.csv")
    master = build_master(
        feeds.load_prices(spark, path), r.sku(spark, sf), r.orders(spark, sf),
        r.inventory(spark, sf), event_counts(r.events(spark, sf)),
        r.competitor_feed(spark, sf), match_on="sku_id")
    return master.select("sku_id", "list_price", "current_price")


@query
def price_csv_feed(spark, sf):
    return feeds.load_prices(spark, _write_price(spark, sf, _folder(spark)))


@query
def price_csv_feed_batch(spark, sf):
    part = r.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    path = _csv(part.toDF("SKU_ID", " Selling_Price"), f"{_folder(spark)}/price.csv")
    return feeds.load_prices(spark, path, "batch")


@query
def orders_csv_feed(spark, sf):
    return sku_sales(feeds.load_orders(spark, _write_orders(spark, sf, _folder(spark))))


@query
def inventory_csv_feed(spark, sf):
    path = _write_inventory(spark, sf, _folder(spark))
    return inventory_features(feeds.load_inventory(spark, path, "batch"))


@query
def events_json_feed(spark, sf):
    path = _write_events(spark, sf, _folder(spark))
    return event_counts(feeds.load_events(spark, path))


@query
def event_counts_json_feed(spark, sf):
    """The pre-aggregated form: every event its own JSON object with one SKU."""
    path = f"{_folder(spark)}/counts"
    r.event_count_maps(spark, sf).select(F.to_json("counts").alias("value")).write.text(path)
    return event_counts_from_map(feeds.load_event_counts(spark, path))


@query
def competitor_json_feed(spark, sf):
    path = _write_competitors(spark, sf, _folder(spark))
    return parse_offers(feeds.load_competitors(spark, path)).select(
        "name", "competitor_price", "competitor_name")


@query
def competitor_results_feed(spark, sf):
    """The same items in `results` wrappers of at most ten names."""
    path = f"{_folder(spark)}/competitor_pricing.json"
    items = r.competitor_feed_by_name(spark, sf)
    wrapped = items.groupBy(F.floor(F.col("feed_pos") / 10)).agg(
        F.collect_list(F.struct("name", "summary")).alias("results"))
    wrapped.select("results").write.json(path)
    return parse_offers(feeds.load_competitors(spark, path)).select(
        "name", "competitor_price", "competitor_name")


@query
def priced_csv_output(spark, sf):
    """Rows with a map column, as CSV under the run's own name."""
    rows = r.features(spark, sf).select("sku_id", "current_price", "all_competitors_json")
    path = tables.write_priced_csv(rows, f"{_folder(spark)}/out", "rule", "2024-01-31_120000",
                                   "v1.0", "A1B2C3")
    return spark.read.schema(
        "sku_id string, current_price double, all_competitors_json string").csv(path, header=True)


@query
def feeds_to_master(spark, sf):
    """All six feeds as files of one folder, loaded and joined by product name."""
    folder = _folder(spark)
    for write in (_write_sku, _write_price, _write_orders, _write_inventory, _write_events,
                  _write_competitors):
        write(spark, sf, folder)
    return master_from_feeds(feeds.load_all(spark, folder))


@query
def written_null_report(spark, sf):
    """Nulls of the raw training rows, counted by the write itself."""
    raw = _golden(spark, sf)
    return tables.write_measured(raw, f"{_folder(spark)}/golden", raw.columns)


def _golden(spark, sf):
    return golden.master_to_golden(r.master(spark, sf), r.orders(spark, sf))


@query
def golden_table(spark, sf):
    path = f"{_folder(spark)}/golden"
    _golden(spark, sf).withColumn("note", F.lit("x")).write.parquet(path)
    return tables.load_golden(spark, path)


@query
def golden_csv_fallback(spark, sf):
    folder = _folder(spark)
    path = _csv(_golden(spark, sf).withColumn("note", F.lit("x")), f"{folder}/golden.csv")
    return tables.load_golden(spark, f"{folder}/absent", path)


@query
def file_as_table(spark, sf):
    folder = _folder(spark)
    part = r.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    path = _csv(part.toDF("part key", "name(en)", "price=eur"), f"{folder}/part.csv")
    tables.file_to_table(spark, path, f"{folder}/part",
                         schema="`part key` bigint, `name(en)` string, `price=eur` double")
    return spark.read.parquet(f"{folder}/part")


@query
def priced_table(spark, sf):
    """A whole hybrid run, written and read back by its run id."""
    out = run_pricing(r.master_with_sales(spark, sf), "hybrid", f"{_folder(spark)}/priced",
                      r.CHAMPION, r.CHAMPION, r.CHALLENGER,
                      settings=PricingSettings(max_mape=2.9),
                      run=Run("2024-01-31_120000", "v1.0", "A1B2C3"))
    return out["priced"].select("sku_id", "final_price", "pricing_strategy", "champion_revenue",
                                "challenger_revenue", "run_date", "model_version", "run_id")


@query
def feature_snapshot(spark, sf):
    """The feature table published twice from the feeds, under two names; readers take the second."""
    base, name = _folder(spark), f"features_{uuid.uuid4().hex}"
    loaded = {"price": r.price(spark, sf), "sku": r.sku(spark, sf), "orders": r.orders(spark, sf),
              "inventory": r.inventory(spark, sf),
              "competitors": r.competitor_feed_by_name(spark, sf)}
    counts = event_counts(r.events(spark, sf))
    publish_features(loaded | {"competitors": loaded["competitors"].filter("false")}, counts,
                     f"{name}_1", f"{base}/1")
    publish_features(loaded, counts, f"{name}_2", f"{base}/2")
    return reload_features(spark, f"{name}_2", as_text=True)


@query
def registry_table(spark, sf):
    """The version history saved as a table and a version registered into it."""
    base, history = _folder(spark), r.registry(spark, sf)
    history.write.parquet(f"{base}/1")
    newest = history.agg(F.max("created_at").alias("created_at")).select(
        F.lit("5-LOW").alias("model_name"), F.lit("v999999999").alias("model_version"),
        F.lit("O").alias("environment"), F.lit("models/new").alias("model_path"),
        F.lit("[]").alias("feature_columns"), "created_at", F.lit(True).alias("is_active"),
        F.lit("None").alias("stage"))
    registry.save_version(f"{base}/2", "5-LOW", "O", newest, spark.read.parquet(f"{base}/1"))
    return spark.read.parquet(f"{base}/2")


@query
def sanitized_master(spark, sf):
    """Nested numbers cleaned: prices relative to a stock that may be zero."""
    rows = r.master(spark, sf).select("sku_id", F.struct(
        (F.col("list_price") / F.nullif(F.col("total_inventory") - 500.0, F.lit(0.0)))
        .alias("per_unit"),
        F.when(F.col("price_diff_pct") > 5, F.lit(float("inf")))
        .when(F.col("price_diff_pct") < -5, F.lit(float("nan")))
        .otherwise(F.col("price_diff_pct")).alias("gap")).alias("n"))
    return quality.sanitize_numbers(rows).select("sku_id", "n.per_unit", "n.gap")
