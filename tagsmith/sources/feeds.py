"""Readers for the six retail feeds.

Two header conventions exist for most feeds and both are kept: `batch` is strict (an absent
column or file is an error), `service` is lenient (aliases, defaults, empty table when the
file is absent). Every reader is lazy, so Spark loads the feeds a plan needs in one job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.functions.fixed_values import (
    BATCH_PRICE_ALIASES, CURRENT_PRICE_ALIASES, DISPLAY_NAME_ALIASES, LIST_PRICE_ALIASES,
    QUANTITY_ALIASES, STOCK_ALIASES,
)
from tagsmith.functions.numeric import parse_number
from tagsmith.operators.quality import require_columns
from tagsmith.sources.columns import (
    first_present, keep_first_of_same_name, measure_column, normalize_headers, resolve_sku_id,
)

_ITEM = "struct<item_id:string,sku_id:string>"
EVENT_SCHEMA = (
    f"event_name string, items array<{_ITEM}>, item_id string, sku_id string, "
    "event_params struct<item_id:string>"
)
_OFFER_ITEM = "struct<name:string,summary:map<string,struct<price:string>>>"
COMPETITOR_SCHEMA = (
    f"name string, summary map<string,struct<price:string>>, results array<{_OFFER_ITEM}>"
)
EVENT_COUNTS_TYPE = "map<string,struct<view_item:bigint,add_to_cart:bigint>>"


def _is_absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_table(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """CSV (header, text columns unless `infer`) or, for any other suffix, Parquet."""
    if path.lower().endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=infer)
    return spark.read.parquet(path)


def _read_or_empty(spark: SparkSession, path: str, empty_schema: str) -> DataFrame:
    try:
        return read_table(spark, path)
    except AnalysisException as error:
        if _is_absent(error):
            return spark.createDataFrame([], empty_schema)
        raise


def _text_id(df: DataFrame) -> DataFrame:
    """Ids are text on both sides of every join."""
    return df.withColumn("sku_id", F.col("sku_id").cast("string"))


# --- SKU names ---------------------------------------------------------------------------
def sku_names(df: DataFrame, variant: str = "service") -> DataFrame:
    df = normalize_headers(df)
    if variant == "batch":
        require_columns(df, ["sku_id", "display_name"])
        return _text_id(df.select("sku_id", "display_name"))
    df = _text_id(resolve_sku_id(keep_first_of_same_name(df), "sku feed"))
    alias = first_present(df, ["display_name", *DISPLAY_NAME_ALIASES]) or "sku_id"
    named = df.select("sku_id", F.col(alias).cast("string").alias("display_name"))
    return named.filter(F.col("sku_id").isNotNull())


def load_sku(spark: SparkSession, path: str, variant: str = "service") -> DataFrame:
    raw = (read_table(spark, path) if variant == "batch"
           else _read_or_empty(spark, path, "sku_id string, display_name string"))
    return sku_names(raw, variant)


# --- prices --------------------------------------------------------------------------------
def prices(df: DataFrame, variant: str = "service") -> DataFrame:
    df = normalize_headers(df)
    if variant == "batch":
        alias = first_present(df, BATCH_PRICE_ALIASES)
        if alias is None:
            raise ValueError(f"price feed: none of {BATCH_PRICE_ALIASES} present")
        return _text_id(df.select("sku_id", parse_number(F.col(alias)).alias("list_price")))
    df = _text_id(resolve_sku_id(keep_first_of_same_name(df), "price feed"))
    list_col = first_present(df, ["list_price", *LIST_PRICE_ALIASES])
    current_col = first_present(df, ["current_price", *CURRENT_PRICE_ALIASES])
    list_price = parse_number(F.col(list_col)) if list_col else F.lit(None).cast("double")
    if current_col:
        current = parse_number(F.col(current_col))
    else:
        current = list_price if list_col else F.lit(0.0)
    return df.select("sku_id", list_price.alias("list_price"), current.alias("current_price"))


def load_prices(spark: SparkSession, path: str, variant: str = "service") -> DataFrame:
    empty = "sku_id string, list_price double, current_price double"
    raw = read_table(spark, path) if variant == "batch" else _read_or_empty(spark, path, empty)
    return prices(raw, variant)


# --- stock and orders ------------------------------------------------------------------------
def quantities(df: DataFrame, aliases: list[str], name: str, variant: str = "service",
               typed: DataFrame | None = None) -> DataFrame:
    """(sku_id, <name>) from a feed with any known id and measure header.

    `typed` is the same feed with inferred types; it is only looked at when no alias matches
    and the first numeric column has to be found.
    """
    df = normalize_headers(df)
    if variant == "batch":
        if "sku_id" not in df.columns and "catalog_ref_id" in df.columns:
            df = df.withColumnRenamed("catalog_ref_id", "sku_id")
        alias = first_present(df, aliases)
        require_columns(df, ["sku_id", alias or aliases[0]])
    else:
        df = keep_first_of_same_name(resolve_sku_id(keep_first_of_same_name(df), f"{name} feed"))
        alias = measure_column(df, aliases)
        if alias is None and typed is not None:
            df = resolve_sku_id(keep_first_of_same_name(normalize_headers(typed)))
            alias = measure_column(df, aliases)
        if alias is None or "sku_id" not in df.columns:
            return df.sparkSession.createDataFrame([], f"sku_id string, {name} double")
    return _text_id(df.select("sku_id", parse_number(F.col(alias)).alias(name)))


def stock(df: DataFrame, variant: str = "service", typed: DataFrame | None = None) -> DataFrame:
    aliases = ["stock_level", "quantity"] if variant == "batch" else STOCK_ALIASES
    return quantities(df, aliases, "stock", variant, typed)


def order_lines(df: DataFrame, variant: str = "service",
                typed: DataFrame | None = None) -> DataFrame:
    aliases = ["quantity", "qty"] if variant == "batch" else QUANTITY_ALIASES
    return quantities(df, aliases, "quantity", variant, typed)


def _load_quantities(spark, path, variant, shape, aliases, empty):
    if variant == "batch":
        return shape(read_table(spark, path), variant)
    raw = _read_or_empty(spark, path, empty)
    known = first_present(normalize_headers(raw), aliases) is not None
    typed = None
    if not known and path.lower().endswith((".csv", ".csv.gz")):
        typed = read_table(spark, path, infer=True)
    return shape(raw, variant, typed)


def load_inventory(spark: SparkSession, path: str, variant: str = "service") -> DataFrame:
    return _load_quantities(spark, path, variant, stock, STOCK_ALIASES,
                            "sku_id string, stock_level double")


def load_orders(spark: SparkSession, path: str, variant: str = "service") -> DataFrame:
    return _load_quantities(spark, path, variant, order_lines, QUANTITY_ALIASES,
                            "sku_id string, quantity double")


# --- web events --------------------------------------------------------------------------------
def load_events(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw events, one JSON object per line, which Spark splits by block. With `multi_line` a file
    may be one JSON list instead: one task reads it whole, so keep such files small."""
    try:
        return spark.read.schema(EVENT_SCHEMA).json(path, multiLine=multi_line)
    except AnalysisException as error:
        if _is_absent(error):
            return spark.createDataFrame([], EVENT_SCHEMA)
        raise


def load_event_counts(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Pre-aggregated form `{sku: {view_item, add_to_cart}}`: one JSON object per line, or, with
    `whole_files`, per file, which must then fit one task."""
    text = spark.read.text(path, wholetext=whole_files)
    return text.select(F.from_json("value", EVENT_COUNTS_TYPE).alias("counts"))


# --- competitor offers ---------------------------------------------------------------------------
def competitor_items(raw: DataFrame) -> DataFrame:
    """One row per feed item from either the bare list or the `results` wrapper.

    `feed_pos` keeps the order of the feed, which decides between items of the same name: file
    and block (columns `file` and `block`), row in the block, position in the wrapper.
    """
    single = F.array(F.struct("name", "summary"))
    items = F.when(F.col("results").isNotNull(), F.col("results")).otherwise(single)
    numbered = raw.select("file", "block", F.monotonically_increasing_id().alias("row"),
                          items.alias("items"))
    exploded = numbered.select("file", "block", "row", F.posexplode("items").alias("pos", "item"))
    return exploded.select(F.struct("file", "block", "row", "pos").alias("feed_pos"),
                           "item.name", "item.summary")


def load_competitors(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Feed items, one JSON object (or `results` wrapper) per line; see `load_events`."""
    try:
        raw = spark.read.schema(COMPETITOR_SCHEMA).json(path, multiLine=multi_line)
        placed = raw.select("*", F.col("_metadata.file_path").alias("file"),
                            F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException as error:
        if not _is_absent(error):
            raise
        placed = spark.createDataFrame([], f"{COMPETITOR_SCHEMA}, file string, block bigint")
    return competitor_items(placed)


def load_all(spark: SparkSession, folder: str, variant: str = "service",
             table_suffix: str = ".csv", multi_line: bool = False) -> dict[str, DataFrame]:
    """All six feeds of a folder as lazy frames."""
    base = folder.rstrip("/")
    return {
        "sku": load_sku(spark, f"{base}/sku.csv", variant),
        "price": load_prices(spark, f"{base}/price.csv", variant),
        "inventory": load_inventory(spark, f"{base}/inventory{table_suffix}", variant),
        "orders": load_orders(spark, f"{base}/purchased_order{table_suffix}", variant),
        "events": load_events(spark, f"{base}/ga4_events.json", multi_line),
        "competitors": load_competitors(spark, f"{base}/competitor_pricing.json", multi_line),
    }
