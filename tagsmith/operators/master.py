"""The master table: one feature row per SKU in stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.numeric import or_default, real
from tagsmith.functions.text import strip
from tagsmith.operators.features import (
    ITEM_KEYS, competitor_features, demand_features, event_counts, first_per_key, inventory_features,
    positions_by_name, with_texts,
)

_COLUMNS = [
    "sku_id", "display_name", "list_price", "current_price", "total_inventory", "inventory_bucket",
    "demand_bucket", "competitor_price", "competitor_name", "competitor_bucket", "price_diff_pct"]
BUCKET_DEFAULTS = {
    "demand_bucket": "LOW", "inventory_bucket": "LOW", "competitor_bucket": "NO_COMPETITOR",
}


def dedup_skus(master: DataFrame, sku: DataFrame) -> DataFrame:
    """One SKU per (display_name, current_price): the lowest id."""
    named = master.drop("display_name").join(
        sku.select("sku_id", "display_name"), "sku_id", "left")
    return first_per_key(named, ["display_name", "current_price"], [F.col("sku_id")])


def build_master(price: DataFrame, sku: DataFrame, orders: DataFrame, inventory: DataFrame,
                 counts: DataFrame, competitor_items: DataFrame, variant: str = "service",
                 match_on: str = "display_name") -> DataFrame:
    """The master table with the text of each row's shops, which is joined last: it is as long as
    the list of the shops. See `master_and_texts` for the rest."""
    rows, texts = master_and_texts(price, sku, orders, inventory, counts, competitor_items, variant, match_on)
    if texts is not None:
        rows = with_texts(rows, texts)
    return rows.select(*_COLUMNS, "all_competitors_json")


def master_and_texts(price: DataFrame, sku: DataFrame, orders: DataFrame, inventory: DataFrame,
                     counts: DataFrame, competitor_items: DataFrame, variant: str = "service",
                     match_on: str = "display_name") -> tuple[DataFrame, DataFrame | None]:
    """Join all features on the SKU id; the shops' texts stay apart, one a feed item, and rows name theirs.
    With `match_on="sku_id"` an item is one SKU's, so its text stands in the row and there are none apart.

    Every input is hashed on `sku_id` exactly once and all joins reuse that partitioning. Stock
    is joined first: the in-stock filter turns that join into an inner one, so SKUs that cannot
    be sold leave before the others. `batch` prices at list price and removes duplicate SKUs
    (the first feed item of a product wins); `service` keeps a separate current price and names
    (the last feed item wins, as in the published table).
    """
    keep = "first" if variant == "batch" else "last"
    if match_on == "display_name":
        offers, texts = positions_by_name(competitor_items, sku, price, keep)
    else:
        offers, texts = competitor_features(competitor_items, sku, price, match_on, keep), None
    # A null id matches no price row; dropping it here keeps it out of the shuffle.
    offers = offers.filter(F.col("sku_id").isNotNull())
    stocked = inventory_features(inventory).filter(F.col("total_inventory") > 0)
    demand = demand_features(orders, counts)

    base = price if variant == "service" else price.select("sku_id", "list_price")
    rows = base.join(stocked, "sku_id", "inner").join(demand, "sku_id", "left")
    rows = rows.join(offers, "sku_id", "left")
    if variant == "service":
        rows = rows.join(sku.select("sku_id", "display_name"), "sku_id", "left")
        current = (or_default(F.col("current_price"), F.col("list_price"))
                   if "current_price" in price.columns else F.col("list_price"))
    else:
        current = F.col("list_price")
    rows = rows.withColumn("current_price", current).fillna(BUCKET_DEFAULTS)
    if variant == "batch":
        rows = dedup_skus(rows, sku)
    return rows.select(*_COLUMNS, *(["all_competitors_json"] if texts is None else ITEM_KEYS)), texts


def master_from_feeds(feeds: dict[str, DataFrame], variant: str = "service") -> DataFrame:
    return build_master(feeds["price"], feeds["sku"], feeds["orders"], feeds["inventory"],
                        event_counts(feeds["events"]), feeds["competitors"], variant)


def last_row_per_sku(rows: DataFrame, position: str) -> DataFrame:
    """The last row of each SKU in the given order wins."""
    return first_per_key(rows, ["sku_id"], [F.col(position).desc()])


def competitor_map() -> Column:
    """The shops' prices as a map, from their text."""
    return F.from_json("all_competitors_json", "map<string,string>").alias("all_competitors_json")


def typed_features(master: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """The published feature row: trimmed id, defaults, competitor map parsed from its text. Rows of
    `master_and_texts` that only name their feed item go on naming it.

    The published table carries zero for demand and web counts. Pass `signals` (sku_id,
    demand_qty, ga4_views, ga4_add_to_cart) to publish the real values instead.
    """
    names = ["demand_qty", "ga4_views", "ga4_add_to_cart"]
    rows = master.drop(*names)
    if signals is None:
        rows = rows.withColumns({c: F.lit(0.0) for c in names})
    else:  # joined before ids are trimmed, while the master is still hashed on them
        rows = rows.join(signals.select("sku_id", *names), "sku_id", "left")
    rows = rows.withColumn("sku_id", strip(F.col("sku_id"))).filter(F.col("sku_id") != "")

    def amount(c: str):
        return F.coalesce(real(F.col(c)), F.lit(0.0))

    name = strip(F.col("display_name"))
    shops = [competitor_map()] if "all_competitors_json" in rows.columns else ITEM_KEYS
    return rows.select(
        "sku_id",
        F.coalesce(F.when(name != "", name), F.col("sku_id")).alias("display_name"),
        amount("list_price").alias("list_price"),
        F.coalesce(real(F.col("current_price")), amount("list_price")).alias("current_price"),
        amount("total_inventory").alias("total_inventory"),
        F.coalesce("inventory_bucket", F.lit("LOW")).alias("inventory_bucket"),
        amount("demand_qty").alias("demand_qty"),
        F.coalesce("demand_bucket", F.lit("LOW")).alias("demand_bucket"),
        real(F.col("competitor_price")).alias("competitor_price"),
        "competitor_name",
        F.coalesce("competitor_bucket", F.lit("NO_COMPETITOR")).alias("competitor_bucket"),
        real(F.col("price_diff_pct")).alias("price_diff_pct"),
        *shops,
        F.coalesce(F.col("ga4_views"), F.lit(0)).cast("bigint").alias("ga4_views"),
        F.coalesce(F.col("ga4_add_to_cart"), F.lit(0)).cast("bigint").alias("ga4_add_to_cart"))


def feature_table_info(features: DataFrame, sample: int = 20) -> DataFrame:
    """Row count beside the first ids in id order (a top-k report)."""
    total = features.agg(F.count(F.lit(1)).alias("sku_count")).scalar()
    first_ids = features.select("sku_id").orderBy("sku_id").limit(sample)
    return first_ids.select(total.alias("sku_count"), "sku_id")
