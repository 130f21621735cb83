import json

import pytest
from pyspark.sql import functions as F

from tagsmith.operators import features as ft, golden, quality
from tagsmith.operators.master import (
    build_master, dedup_skus, feature_table_info, last_row_per_sku, typed_features,
)
from tagsmith.sources import tables
from tagsmith.sources.feeds import EVENT_SCHEMA
from tagsmith.workload import roles as r


def rows(df, *cols):
    return sorted(tuple(x) for x in (df.select(*cols) if cols else df).collect())


def test_sales_skip_missing_amounts(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("b", None), (None, 5.0),
                                ("c", float("nan"))], "sku_id string, quantity double")
    assert rows(ft.sku_sales(df)) == [("a", 2.0), ("b", 0.0), ("c", 0.0)]


def test_event_items_and_fallbacks(spark):
    none = (None, None, None)
    data = [
        ("view_item", [("a", None), (None, "b"), ("", "c"), (None, None)], *none),
        ("add_to_cart", [], "a", None, None),
        ("add_to_cart", None, "", "b", None),
        ("view_item", None, None, None, ("d",)),
        ("purchase", [("a", None)], *none),
        ("view_item", [("a", None)], "zzz", "zzz", None),
    ]
    events = spark.createDataFrame(data, EVENT_SCHEMA)
    assert rows(ft.event_counts(events)) == [("a", 2, 1), ("b", 1, 1), ("d", 1, 0)]


def test_event_counts_from_maps(spark):
    df = spark.createDataFrame(
        [({"a": (2, 1), "b": (None, 4)},), ({"a": (3, None)},)],
        "counts map<string,struct<view_item:bigint,add_to_cart:bigint>>")
    assert rows(ft.event_counts_from_map(df)) == [("a", 5, 1), ("b", 0, 4)]


def test_demand_score_without_events(spark):
    sales = spark.createDataFrame([("a", 10.0), ("b", 4.0)], "sku_id string, total_sales double")
    counts = spark.createDataFrame([("zz", 9, 9)],
                                   "sku_id string, views bigint, add_to_cart bigint")
    got = rows(ft.score_demand(ft.demand_signals(sales, counts)), "sku_id", "score",
               "demand_bucket")
    assert got == [("a", 0.5, "MED"), ("b", 0.2, "LOW")]


FEED = ("feed_pos bigint, name string, sku_id string, "
        "shops array<struct<site:string,offer:struct<price:string>>>")


def feed(spark, items):
    """Feed items with their sites in the written order (a map made in Python may lose it)."""
    listed = spark.createDataFrame(
        [(i, n, s, [(k, (v,)) for k, v in m.items()] if m is not None else None)
         for i, (n, s, m) in enumerate(items)], FEED)
    return listed.withColumn("summary", F.map_from_entries("shops")).drop("shops")


def test_cheapest_offer_first_site_wins(spark):
    items = feed(spark, [
        ("x", None, {"s1": "12.5", "s2": "9.999", "s3": "9.999", "s4": "1,299", "s5": "",
                     "s6": "nan", "s7": "inf", "s8": "0", "s9": None}),
        ("y", None, {}), ("z", None, None)])
    got = {x["name"]: x for x in ft.parse_offers(items).collect()}
    assert (got["x"]["competitor_price"], got["x"]["competitor_name"]) == (9.999, "s2")
    assert got["x"]["all_competitors"] == {"s1": "12.5", "s2": "10.0", "s3": "10.0"}
    assert got["y"]["competitor_price"] is None and got["y"]["all_competitors"] == {}
    assert got["z"]["competitor_price"] is None


SKU = "sku_id string, display_name string"
PRICE = "sku_id string, list_price double"


def test_feed_items_meet_all_skus_of_a_name(spark):
    sku = spark.createDataFrame([("1", "mug"), ("2", "mug"), ("3", "cup"), ("4", None)], SKU)
    price = spark.createDataFrame([("1", 10.0), ("2", 9.0), ("3", 5.0)], PRICE)
    items = feed(spark, [("mug", None, {"s": "9"}), ("mug", None, {"t": "8"}),
                         ("jar", None, {"s": "1"}), (None, None, {"s": "2"})])
    cols = ("sku_id", "competitor_price", "competitor_bucket", "price_diff_pct")
    everything = ft.competitor_features(items, sku, price, keep="all").select(*cols).collect()
    matched = sorted(tuple(x) for x in everything if x["sku_id"])
    assert matched == [("1", 8.0, "COMPETITOR_CHEAPER", 25.0),
                       ("1", 9.0, "COMPETITOR_CHEAPER", 11.11),
                       ("2", 8.0, "COMPETITOR_CHEAPER", 12.5), ("2", 9.0, "SAME", 0.0)]
    assert sorted(x["competitor_price"] for x in everything if not x["sku_id"]) == [1.0, 2.0]
    first = ft.competitor_features(items, sku, price, keep="first").filter("sku_id = '1'")
    last = ft.competitor_features(items, sku, price, keep="last").filter("sku_id = '1'")
    assert first.first()["competitor_price"] == 9.0 and last.first()["competitor_price"] == 8.0


@pytest.fixture(scope="module")
def small_feeds(spark):
    return {
        "price": spark.createDataFrame(
            [("1", 10.0, 0.0), ("2", 10.0, None), ("3", 7.0, 6.0), ("4", 1.0, 1.0)],
            PRICE + ", current_price double"),
        "sku": spark.createDataFrame([("1", "mug"), ("2", "mug"), ("3", "cup"), ("4", "jar")], SKU),
        "orders": spark.createDataFrame([("1", 5.0), ("3", 1.0)],
                                        "sku_id string, quantity double"),
        "inventory": spark.createDataFrame([("1", 600.0), ("1", 600.0), ("2", 1.0), ("3", 150.0),
                                            ("4", 0.0)], "sku_id string, stock double"),
        "counts": spark.createDataFrame([("1", 3, 1)],
                                        "sku_id string, views bigint, add_to_cart bigint"),
        "items": feed(spark, [("mug", None, {"s": "9"}), ("mug", None, {"t": "11"})]),
    }


def build(f, variant):
    return build_master(f["price"], f["sku"], f["orders"], f["inventory"], f["counts"],
                        f["items"], variant)


def test_service_master(small_feeds):
    got = {x["sku_id"]: x for x in build(small_feeds, "service").collect()}
    assert set(got) == {"1", "2", "3"}  # 4 has no stock
    assert (got["1"]["current_price"], got["2"]["current_price"], got["3"]["current_price"]) == (
        10.0, 10.0, 6.0)
    assert got["1"]["competitor_price"] == 11.0  # the last item of the feed
    assert (got["1"]["inventory_bucket"], got["1"]["demand_bucket"]) == ("VERY_HIGH", "HIGH")
    assert (got["3"]["competitor_bucket"], got["2"]["demand_bucket"]) == ("NO_COMPETITOR", "LOW")


def test_batch_master_removes_duplicates(small_feeds):
    got = {x["sku_id"]: x for x in build(small_feeds, "batch").collect()}
    assert set(got) == {"1", "3"}  # 2 repeats name and price of 1
    assert got["1"]["competitor_price"] == 9.0  # the first item of the feed
    assert got["3"]["current_price"] == 7.0  # list price


def test_dedup_counts_missing_names_as_equal(spark):
    priced = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)],
                                   "sku_id string, current_price double")
    sku = spark.createDataFrame([("zz", "zz")], SKU)
    assert [x[0] for x in rows(dedup_skus(priced, sku), "sku_id")] == ["a", "c"]


def test_typed_features(spark, small_feeds):
    base = build(small_feeds, "service").withColumn("sku_id", F.concat(F.lit(" "), "sku_id"))
    extra = base.limit(1).withColumns({"sku_id": F.lit("  "), "display_name": F.lit("")})
    got = {x["sku_id"]: x for x in typed_features(base.unionByName(extra)).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"]["all_competitors_json"] == {"t": "11.0"} and got["1"]["demand_qty"] == 0.0
    assert got["3"]["all_competitors_json"] is None
    signals = spark.createDataFrame(
        [(" 1", 5.0, 3, 1)],
        "sku_id string, demand_qty double, ga4_views bigint, ga4_add_to_cart bigint")
    real = {x["sku_id"]: x for x in typed_features(base, signals).collect()}
    assert (real["1"]["demand_qty"], real["1"]["ga4_views"], real["2"]["demand_qty"]) == (
        5.0, 3, 0.0)
    bad = base.withColumn("all_competitors_json", F.lit("{broken"))
    assert typed_features(bad).first()["all_competitors_json"] is None


def test_feature_table_info(spark):
    df = spark.range(50).select(F.format_string("%03d", "id").alias("sku_id"))
    got = feature_table_info(df).collect()
    assert [x["sku_id"] for x in got] == [f"{i:03d}" for i in range(20)]
    assert {x["sku_count"] for x in got} == {50}


def test_last_row_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")],
                               "sku_id string, pos int, v string")
    assert rows(last_row_per_sku(df, "pos"), "sku_id", "v") == [("a", "z"), ("b", "q")]


# --- golden and quality -----------------------------------------------------------------------
GOLDEN = ("sku_id string, price double, competitor_price double, inventory_level double, "
          "price_diff_pct double, demand_qty double")


def test_golden_cleaning(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 10.0, None, None, nan, 3.0), ("b", 10.0, 9.0, 5.0, 1.0, None),
         ("c", nan, 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0)], GOLDEN)
    assert rows(quality.clean_golden(df, df.columns)) == [("a", 10.0, 10.0, 0.0, 0.0, 3.0)]
    report = {x["column_name"]: x["null_count"]
              for x in quality.null_report(df, df.columns).collect()}
    assert report == {"sku_id": 1, "price": 1, "competitor_price": 1, "inventory_level": 1,
                      "price_diff_pct": 1, "demand_qty": 1}
    with pytest.raises(quality.MissingColumnsError):
        quality.require_columns(df, ["nope"])
    assert quality.require_columns(df, ["nope"], raise_on_error=False) is False


def test_golden_bridge(spark):
    df = spark.createDataFrame([("a", 10.0, 9.0, 1500.0, 11.1, 100.0),
                                ("b", 10.0, 12.0, 50.0, -16.7, 50.0)], GOLDEN)
    got = rows(golden.golden_to_pricing(df), "sku_id", "current_price", "inventory_bucket",
               "demand_bucket", "competitor_bucket")
    assert got == [("a", 10.0, "VERY_HIGH", "HIGH", "COMPETITOR_CHEAPER"),
                   ("b", 10.0, "LOW", "MED", "WE_CHEAPER")]


def test_nested_numbers_are_sanitized(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [(1, nan, [1.0, inf], {"k": -inf}, (nan, "t"), None)],
        "i int, x double, a array<double>, m map<string,double>, s struct<y:double,t:string>, "
        "n struct<y:double>")
    row = quality.sanitize_numbers(df).first()
    assert (row["x"], row["a"], row["m"], row["s"]["y"], row["s"]["t"], row["n"]) == (
        0.0, [1.0, 0.0], {"k": 0.0}, 0.0, "t", None)


def test_request_ids(spark):
    df = spark.createDataFrame([(0, " a "), (1, "\tb\n"), (2, "a"), (3, "   "), (4, None),
                                (5, "A")], "pos int, sku_id string")
    assert rows(quality.clean_request_ids(df)) == [("A", 5), ("a", 0), ("b", 1)]


# --- counts of the derived retail tables, known from counting them with SQL ----------------------
def test_class_counts_of_the_small_tables(spark, sf):
    master = r.master(spark, sf).cache()
    count = lambda c: {x[0]: x[1] for x in master.groupBy(c).count().collect()}
    assert count("inventory_bucket") == {"LOW": 8, "MED": 55, "HIGH": 74, "VERY_HIGH": 18}
    assert count("demand_bucket") == {"LOW": 82, "MED": 71, "HIGH": 2}
    assert count("competitor_bucket") == {
        "COMPETITOR_CHEAPER": 67, "WE_CHEAPER": 64, "SAME": 4, "NO_COMPETITOR": 20}
    assert master.filter("abs(price_diff_pct) > 20").count() == 34
    texts = master.filter("all_competitors_json is not null").first()["all_competitors_json"]
    assert json.loads(texts)
    master.unpersist()


def _shuffled_by_sku_with(spark, df, column):
    """Exchanges by SKU whose rows carry the column."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [part for part in text.split("\n\n") if "Exchange\n" in part and column in part and "hashpartitioning(sku_id" in part]


def test_a_text_per_sku_is_not_shuffled(spark):
    skus = 2 * ft.SKUS_PER_COPY + 1
    sku = spark.range(skus).select(F.col("id").cast("string").alias("sku_id"), F.lit("mug").alias("display_name"))
    price = sku.select("sku_id", F.lit(10.0).alias("list_price"))
    items = feed(spark, [("mug", None, {"s": "9", "t": "11"}), ("jar", None, {"s": "1"})])
    got = ft.competitor_features(items, sku, price)
    assert not _shuffled_by_sku_with(spark, got, "all_competitors")
    found = got.groupBy("all_competitors_json", "competitor_price", F.col("sku_id").isNull().alias("lost")).agg(
        F.count_distinct("sku_id").alias("skus"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(tuple(x) for x in found) == [
        ('{"s":"1.0"}', 1.0, True, 0, 1), ('{"s":"9.0","t":"11.0"}', 9.0, False, skus, skus)]


def test_master_shuffles_no_text_per_sku(spark, small_feeds):
    for variant in ("service", "batch"):
        assert not _shuffled_by_sku_with(spark, build(small_feeds, variant), "all_competitors")


def test_files_keep_a_long_text_once_for_its_rows(spark, tmp_path):
    """Two texts of more than a megabyte beside 400 rows: not 400 copies of them in the file."""
    shops = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.struct(
        F.concat(F.lit("site_"), i.cast("string")), F.struct((i * 1.25 + F.col("id")).cast("string").alias("price"))))
    items = spark.range(2).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("x").alias("sku_id"),
                                  F.col("id").alias("feed_pos"), F.map_from_entries(shops).alias("summary"))
    sku = spark.range(400).select(F.col("id").cast("string").alias("sku_id"),
                                  F.concat(F.lit("n"), F.col("id") % 2).alias("display_name"))
    price = sku.select("sku_id", F.lit(7.0).alias("list_price"))
    path = str(tmp_path / "out")
    ft.competitor_features(items, sku, price).write.parquet(path)
    files = [f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(files) < 10_000_000
    got = spark.read.parquet(path).select("sku_id", F.length("all_competitors_json").alias("n")).collect()
    assert len({r["sku_id"] for r in got}) == len(got) == 400 and min(r["n"] for r in got) > 700_000


def test_a_session_keeps_its_own_parquet_settings(spark):
    session = spark.newSession()
    session.conf.set("parquet.dictionary.page.size", "12345")
    tables.keep_texts_once(session, "c")
    tables.keep_texts_once(session, "c")
    assert session.conf.get("parquet.dictionary.page.size") == "12345"
    assert session.conf.get("parquet.column.statistics.enabled#c") == "false"
