"""Retail roles derived from the benchmark tables.

Every role is a lazy frame over whole tables. Parts are SKUs with their prices, order lines are
orders and stock movements (the supplier decides whether goods come in or go out), events are web
events, and the suppliers of a part are the shops that offer it.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.operators.demand_models import LinearDemand
from tagsmith.operators.features import event_counts, sku_sales
from tagsmith.operators.master import build_master, typed_features
from tagsmith.plans.request_pricing import reload_features
from tagsmith.sources.feeds import order_lines, prices, sku_names, stock
from tagsmith.sources.tables import materialized, publish_table, shared_folder

CHAMPION = LinearDemand(1500.0, price=-0.5, competitor=0.1, inventory=0.02, gap=-1.0)
CHALLENGER = LinearDemand(1400.0, price=-0.4, competitor=0.05, inventory=0.01, gap=-2.0)


# Declared, so that no job reads file footers just to find the columns.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


# Roles are immutable lazy plans, so each is put together once per session and folder.
once = lru_cache(maxsize=256)


@once
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@once
def sku(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    return sku_names(part.select(_text("p_partkey").alias("sku_id"),
                                 F.col("p_name").alias("display_name")))


@once
def price(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    return prices(part.select(_text("p_partkey").alias("sku_id"),
                              F.col("p_retailprice").alias("list_price")))


@once
def orders(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return order_lines(lines.select(_text("l_partkey").alias("sku_id"),
                                    F.col("l_quantity").alias("quantity")))


@once
def inventory(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    moved = F.col("l_quantity") * (F.col("l_suppkey") % 10 - 4)
    return stock(lines.select(_text("l_partkey").alias("catalog_ref_id"),
                              moved.alias("stock_level")))


def _event_kind() -> Column:
    kind = F.col("event_type")
    return (F.when(kind == "view", "view_item").when(kind == "click", "add_to_cart")
            .otherwise(kind))


def shape_events(raw: DataFrame) -> DataFrame:
    """Web events in the three places an item id may stand: items, top level, parameters."""
    item = F.get_json_object("props", "$.k")
    place = F.col("event_id") % 3
    nothing = F.lit(None).cast("string")
    listed = F.array(F.struct(item.alias("item_id"), nothing.alias("sku_id")))
    return raw.select(
        _event_kind().alias("event_name"),
        F.when(place == 0, listed).otherwise(F.array().cast(
            "array<struct<item_id:string,sku_id:string>>")).alias("items"),
        nothing.alias("item_id"),
        F.when(place == 1, item).alias("sku_id"),
        F.struct(F.when(place == 2, item).alias("item_id")).alias("event_params"),
        "ts")


@once
def events(spark, sf) -> DataFrame:
    return shape_events(table(spark, sf, "events"))


@once
def event_count_maps(spark, sf) -> DataFrame:
    """The pre-aggregated form, one small map per event."""
    kind = _event_kind()
    counts = F.struct((kind == "view_item").cast("bigint").alias("view_item"),
                      (kind == "add_to_cart").cast("bigint").alias("add_to_cart"))
    return table(spark, sf, "events").select(
        F.create_map(F.get_json_object("props", "$.k"), counts).alias("counts"))


def _summary(offers: Column) -> Column:
    """Site-to-price map from (shop, price) pairs in shop order; a price may be missing."""
    return F.map_from_entries(F.transform(offers, lambda o: F.struct(
        F.concat(F.lit("site_"), o["shop"]), F.struct(o["price"].cast("string").alias("price")))))


@once
def _shop_prices(spark, sf) -> DataFrame:
    """Every shop that delivers a part, in shop order, with its price; every ninth part is
    listed without prices. A part holds each shop once, however many lines it has."""
    shops = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sort_array(F.collect_set("l_suppkey")).alias("shops"))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    key = F.col("p_partkey")

    def offer(shop: Column) -> Column:
        factor = 74 + key * 7 % 53 + (key + shop * 13) % 5
        return F.struct(shop.alias("shop"), F.when(
            key % 9 != 0, F.col("p_retailprice") * factor / 100).alias("price"))

    return shops.join(part, shops["l_partkey"] == key, "inner").select(
        _text("p_partkey").alias("sku_id"), F.col("p_name").alias("name"),
        key.alias("feed_pos"), F.transform("shops", offer).alias("offers"))


@once
def competitor_feed(spark, sf) -> DataFrame:
    """One feed item per SKU, carrying our id; written once, as a feed arrives."""
    return materialized(_shop_prices(spark, sf).select(
        "sku_id", "name", "feed_pos", _summary(F.col("offers")).alias("summary")), "feed_by_sku")


@once
def competitor_feed_by_name(spark, sf) -> DataFrame:
    """One feed item per product name, as shops list it: each shop once, at its best price; written once."""
    each = _shop_prices(spark, sf).select("name", "feed_pos", F.explode("offers").alias("o"))
    best = each.groupBy("name", "o.shop").agg(
        F.min("feed_pos").alias("feed_pos"), F.min("o.price").alias("price"))
    named = best.groupBy("name").agg(
        F.min("feed_pos").alias("feed_pos"),
        F.sort_array(F.collect_list(F.struct("shop", "price"))).alias("offers"))
    return materialized(
        named.select("name", "feed_pos", _summary(F.col("offers")).alias("summary")), "feed_by_name")


@once
def master(spark, sf, variant: str = "service") -> DataFrame:
    return build_master(price(spark, sf), sku(spark, sf), orders(spark, sf),
                        inventory(spark, sf), event_counts(events(spark, sf)),
                        competitor_feed(spark, sf), variant, match_on="sku_id")


@once
def master_with_sales(spark, sf) -> DataFrame:
    """Service master with the ordered quantity, zero where nothing was ordered."""
    sold = sku_sales(orders(spark, sf), "demand_qty")
    return master(spark, sf).join(sold, "sku_id", "left").fillna({"demand_qty": 0.0})


def _prefixed(df: DataFrame) -> DataFrame:
    return df.withColumn("sku_id", F.concat(F.lit("p"), "sku_id"))


@once
def features(spark, sf) -> DataFrame:
    """Published feature rows with real demand and web counts; ids carry the prefix `p`."""
    sold = sku_sales(orders(spark, sf), "demand_qty")
    counts = event_counts(events(spark, sf))
    signals = sold.join(counts, "sku_id", "left").select(
        "sku_id", "demand_qty", F.col("views").alias("ga4_views"),
        F.col("add_to_cart").alias("ga4_add_to_cart"))
    return _prefixed(typed_features(master(spark, sf), signals))


@once
def published(spark, sf) -> DataFrame:
    """The feature rows as request pricing finds them: published once, bucketed by SKU."""
    name = f"published_{uuid.uuid4().hex}"
    publish_table(features(spark, sf), name, f"{shared_folder(spark)}/{name}", "sku_id")
    return reload_features(spark, name)


@once
def requests(spark, sf) -> DataFrame:
    """Requested ids as people type them: padded, upper case, blank, unknown, plain."""
    number, kind = _text("o_custkey"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.when(kind == "1", F.concat(F.lit("  p"), number, F.lit(" ")))
        .when(kind == "2", F.concat(F.lit("P"), number))
        .when(kind == "3", F.lit("   "))
        .when(kind == "4", F.concat(F.lit("x"), number))
        .otherwise(F.concat(F.lit("p"), number)).alias("sku_id"))


@once
def registry(spark, sf) -> DataFrame:
    """A long version history: orders as registered versions, priorities as models."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model_name"),
        F.concat(F.lit("v"), _text("o_custkey")).alias("model_version"),
        F.col("o_orderstatus").alias("environment"),
        F.format_string("models/%012d", "o_orderkey").alias("model_path"),
        F.lit('["price", "competitor_price", "inventory_level", "price_diff_pct"]')
        .alias("feature_columns"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 3 == 0).alias("is_active"),
        F.when(F.col("o_orderkey") % 50 == 0, "Production").otherwise("None").alias("stage"))


@once
def search_queries(spark, sf) -> DataFrame:
    """Documents as search texts, their language as the attribute asked for."""
    return table(spark, sf, "documents").select(
        _text("doc_id").alias("user_pseudo_id"), F.col("text").alias("search_query"),
        F.col("source").alias("sku"), F.col("lang").alias("standard_attribute_key"))


@once
def scored_queries(spark, sf) -> DataFrame:
    """Classified queries; longer texts are the surer ones, doc ids give the minute."""
    docs = table(spark, sf, "documents")
    return docs.selectExpr(
        "cast(doc_id AS string) AS user_pseudo_id", "text AS search_query", "source AS sku",
        "lang AS standard_attribute_key", "n_chars / (n_chars + 1000.0D) AS confidence_score",
        "'v1' AS model_version",
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(doc_id AS int)) "
        "AS event_timestamp")


@once
def sku_attributes(spark, sf) -> DataFrame:
    """Attributes the catalogue has: those of documents labelled as good."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return docs.join(good, "doc_id", "left_semi").select(
        F.col("source").alias("sku"), F.col("lang").alias("standard_attribute_key"))
