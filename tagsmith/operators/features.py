"""Feature builders: per-SKU demand, stock and competitor features.

All per-SKU totals are plain `groupBy().agg()`; Spark adds up each key inside every task before
the shuffle, so one SKU holding a third of the rows sends one row per task, not a third of the
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.functions.labels import (
    competitor_label, demand_label, demand_score, price_gap_pct, stock_label,
)
from tagsmith.functions.maps import entries_of
from tagsmith.functions.numeric import parse_number, price_text, real
from tagsmith.sources.tables import keep_texts_once


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark trims every task to one row per key before the
    shuffle (window group limit), so hot keys stay small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


# --- demand --------------------------------------------------------------------------------
def sku_sales(orders: DataFrame, name: str = "total_sales") -> DataFrame:
    """Units sold per SKU from (sku_id, quantity) lines."""
    known = orders.filter(F.col("sku_id").isNotNull())
    return known.groupBy("sku_id").agg(
        F.coalesce(F.sum(real(F.col("quantity"))), F.lit(0.0)).alias(name))


def _non_blank(c: Column) -> Column:
    return F.when(c != "", c)


def event_items(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(sku_id, event_name) for every item of the two counted event kinds.

    An event without items names its SKU at the top level or in its parameters.
    """
    counted = events.filter(F.col("event_name").isin("view_item", "add_to_cart"))
    listed = F.transform("items", lambda i: F.coalesce(i["item_id"], i["sku_id"]))
    fallback = F.coalesce(_non_blank(F.col("item_id")), _non_blank(F.col("sku_id")),
                          _non_blank(F.col("event_params.item_id")))
    ids = F.when(F.size("items") > 0, listed).otherwise(F.array(fallback))
    return (counted.select("event_name", *(keep or []), F.explode(ids).alias("sku_id"))
            .filter(F.col("sku_id") != ""))


def event_counts(events: DataFrame) -> DataFrame:
    """Views and cart additions per SKU, both in one pass."""
    return event_items(events).groupBy("sku_id").agg(
        F.count_if(F.col("event_name") == "view_item").alias("views"),
        F.count_if(F.col("event_name") == "add_to_cart").alias("add_to_cart"))


def event_counts_from_map(counts: DataFrame) -> DataFrame:
    """The same from the pre-aggregated `{sku: {view_item, add_to_cart}}` form."""
    each = counts.select(F.explode(entries_of(F.col("counts"))).alias("e"))
    return each.groupBy(F.col("e.key").alias("sku_id")).agg(
        F.sum(F.coalesce("e.value.view_item", F.lit(0))).alias("views"),
        F.sum(F.coalesce("e.value.add_to_cart", F.lit(0))).alias("add_to_cart"))


def demand_signals(sales: DataFrame, counts: DataFrame) -> DataFrame:
    """Sales with the web signals beside them; SKUs that never sold are not listed."""
    return sales.join(counts, "sku_id", "left").select(
        "sku_id", "total_sales",
        F.coalesce(F.col("views"), F.lit(0)).cast("double").alias("views"),
        F.coalesce(F.col("add_to_cart"), F.lit(0)).cast("double").alias("add_to_cart"))


def score_demand(signals: DataFrame) -> DataFrame:
    """Scale each signal by its global maximum, weigh, and label.

    The maxima are one row, taken as scalar subqueries: no window over the whole table and no
    join against it.
    """
    names = ["total_sales", "add_to_cart", "views"]
    tops = signals.agg(F.struct(*[F.max(c).alias(c) for c in names]).alias("tops")).scalar()
    scaled = signals.withColumn("_tops", tops)

    def share(c: str) -> Column:
        top = F.col("_tops")[c]
        return F.when(top > 0, F.col(c) / top).otherwise(F.col(c))

    scored = scaled.withColumn("score", demand_score(*[share(c) for c in names]))
    return scored.withColumn("demand_bucket", demand_label(F.col("score"))).drop("_tops")


def demand_features(orders: DataFrame, counts: DataFrame) -> DataFrame:
    signals = demand_signals(sku_sales(orders), counts)
    return score_demand(signals).select("sku_id", "demand_bucket")


# --- stock -----------------------------------------------------------------------------------
def inventory_features(stock: DataFrame) -> DataFrame:
    """Total stock per SKU and its band; unreadable amounts count as zero."""
    known = stock.filter(F.col("sku_id").isNotNull())
    total = known.groupBy("sku_id").agg(
        F.sum(F.coalesce(real(F.col("stock")), F.lit(0.0))).alias("total_inventory"))
    return total.withColumn("inventory_bucket", stock_label(F.col("total_inventory")))


# --- competitors -------------------------------------------------------------------------------
def parse_offers(items: DataFrame) -> DataFrame:
    """Cheapest offer and the site-to-price map of each feed item, computed inside the row.

    A summary is one product's list of shops; nothing is exploded and nothing is shuffled.
    """
    entries = F.transform(
        entries_of(F.col("summary")),
        lambda e, i: F.struct(parse_number(e["value"]["price"]).alias("price"),
                              i.alias("pos"), e["key"].alias("site")))
    valid = F.filter(F.coalesce(entries, F.array()),
                     lambda o: o["price"].isNotNull() & (o["price"] != 0.0))
    parsed = items.withColumn("offers", valid)
    cheapest = F.array_min("offers")
    texts = F.map_from_entries(F.transform(
        "offers", lambda o: F.struct(o["site"], price_text(o["price"]))))
    return parsed.withColumns({
        "competitor_price": cheapest["price"],
        "competitor_name": cheapest["site"],
        "all_competitors": texts,
    }).drop("offers", "summary")


def one_item_per(items: DataFrame, key: str, keep: str) -> DataFrame:
    """The first or last feed item of each name (or SKU)."""
    order = F.col("feed_pos").asc() if keep == "first" else F.col("feed_pos").desc()
    return first_per_key(items.filter(F.col(key).isNotNull()), [key], [order])


def matched_and_unmatched(parsed: DataFrame, sku: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed items beside every SKU of the same name, and the items without a SKU (null id).

    An inner join and the unmatched items instead of one outer join: Spark can then
    split a hot name on either side (the outer form pins the side that holds the SKUs).
    """
    names = sku.select("sku_id", "display_name")
    offers = parsed.drop("sku_id").withColumnRenamed("name", "display_name")
    matched = offers.join(names, "display_name", "inner")
    # Only the names are needed here, once each, so a hot name is a single row.
    known = names.select("display_name").distinct()
    unmatched = offers.join(known, "display_name", "left_anti").withColumn(
        "sku_id", F.lit(None).cast("string"))
    return matched, unmatched


def match_offers_to_skus(parsed: DataFrame, sku: DataFrame) -> DataFrame:
    """Feed items beside every SKU of the same name; items without a SKU keep a null id."""
    matched, unmatched = matched_and_unmatched(parsed, sku)
    return matched.unionByName(unmatched)


#: SKUs of one name that share a copy of its feed item's text in `with_texts`.
SKUS_PER_COPY = 1000
#: How a row names its feed item, and the copy of the item's text that it takes.
ITEM_KEYS = ["_item", "_copy"]


def _position(*before: str) -> list[Column | str]:
    ours, theirs = F.col("list_price"), F.col("competitor_price")
    return [*before, "competitor_price", "competitor_name",
            competitor_label(ours, theirs).alias("competitor_bucket"),
            price_gap_pct(ours, theirs).alias("price_diff_pct")]


def positions_by_name(items: DataFrame, sku: DataFrame, price: DataFrame,
                      keep: str = "last") -> tuple[DataFrame, DataFrame]:
    """Competitor position per SKU without the shops' prices, and these as text, one row per name.

    An item lists all shops of its product, so beside every SKU of the name it is far larger than the
    feed. Positions only name their item (`_item`, `_copy`); `with_texts` puts the texts beside them,
    last of all. A name gets one copy of its text for every `SKUS_PER_COPY` SKUs, so a hot name is dealt out.
    """
    parsed = parse_offers(one_item_per(items, "name", keep)).withColumnRenamed("name", "display_name")
    names = sku.select("sku_id", "display_name")
    known = names.groupBy("display_name").agg(
        F.ceil(F.count(F.lit(1)) / SKUS_PER_COPY).alias("_copies"))
    placed = parsed.join(known, "display_name", "left")
    texts = placed.select(F.col("display_name").alias("_item"), "_copies",
                          F.to_json("all_competitors").alias("all_competitors_json"))

    offers = placed.select("display_name", "competitor_price", "competitor_name", "_copies")
    matched = offers.join(names, "display_name", "inner").join(
        price.select("sku_id", "list_price"), "sku_id", "left")
    # without an id there is no price: these stay out of the join, where they'd be one key
    unmatched = offers.where(F.col("_copies").isNull()).withColumns({
        "sku_id": F.lit(None).cast("string"), "list_price": F.lit(None).cast("double")})
    copy = F.pmod(F.xxhash64("sku_id"), F.coalesce("_copies", F.lit(1)))
    positions = matched.unionByName(unmatched).select(
        *_position("sku_id"), F.col("display_name").alias("_item"), copy.alias("_copy"))
    return positions, texts


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows that name their feed item with its text. Only the copies of the texts are shuffled, never a text
    per row; the number of partitions is given, as adaptive execution would merge them by what goes in.
    A task has the rows of a copy one after the other, and Parquet files keep the text once for all of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep_texts_once(rows.sparkSession, "all_competitors_json")
    dealt = rows.withColumn("_copy", F.coalesce("_copy", F.pmod(F.xxhash64("sku_id"), F.lit(n))))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)) - 1)
    texts = texts.select("_item", F.explode(copies).alias("_copy"), "all_competitors_json")
    return dealt.repartition(n, *ITEM_KEYS).join(
        texts.repartition(n, *ITEM_KEYS), ITEM_KEYS, "left").drop(*ITEM_KEYS)


def competitor_features(items: DataFrame, sku: DataFrame, price: DataFrame,
                        match_on: str = "display_name", keep: str = "last") -> DataFrame:
    """Competitor position per SKU.

    `match_on="display_name"` follows the feed, which names products; `"sku_id"` is for feeds
    that carry our id. `keep` chooses what happens when the feed lists a product again:
    `first`/`last` keep one item, before the join rather than after a fan-out, as the master table
    does. `all` keeps every item beside every SKU of the name: items times SKUs of a hot name.
    """
    if match_on == "display_name" and keep != "all":
        return with_texts(*positions_by_name(items, sku, price, keep))
    chosen = items if keep == "all" else one_item_per(items, "sku_id", keep)
    parsed = parse_offers(chosen)
    prices = price.select("sku_id", "list_price")
    if match_on == "display_name":
        placed, unmatched = matched_and_unmatched(parsed, sku)
        # without an id there is no price: these stay out of the join, where they'd be one key
        unpriced = unmatched.withColumn("list_price", F.lit(None).cast("double"))
        priced = placed.join(prices, "sku_id", "left").unionByName(unpriced)
    else:
        priced = parsed.join(prices, "sku_id", "left")
    return priced.select(*_position("sku_id"), F.to_json("all_competitors").alias("all_competitors_json"))
