import json
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tagsmith.operators.features import (
    event_counts, event_counts_from_map, one_item_per, parse_offers,
)
from tagsmith.operators import quality
from tagsmith.operators.master import master_from_feeds
from tagsmith.operators.requests import find_ids, find_requested
from tagsmith.plans.pricing import Run, stamp
from tagsmith.plans.request_pricing import publish_features, reload_features, with_shops
from tagsmith.sources import columns, feeds, tables


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


# --- headers ----------------------------------------------------------------------------------
def test_header_cleanup(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "` SKU ` int, Id int, `Sku` int, x int")
    low = columns.normalize_headers(df)
    assert low.columns == ["sku", "id", "sku", "x"]
    once = columns.keep_first_of_same_name(low)
    assert once.columns == ["sku", "id", "x"] and once.first()["sku"] == 1
    assert columns.resolve_sku_id(once).columns == ["sku_id", "id", "x"]
    plain = spark.createDataFrame([(1,)], "other int")
    assert columns.resolve_sku_id(plain).columns == ["other"]


def test_name_sanitizing(spark):
    df = spark.createDataFrame([(1, 2)], "`a b(c)` int, `=x;` int")
    assert columns.sanitize_names(df).columns == ["a_b_c", "x"]
    with pytest.raises(ValueError):
        columns.sanitize_names(spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int"))


def test_measure_column(spark):
    df = spark.createDataFrame([("a", "t", 1.0)], "sku_id string, note string, amount double")
    assert columns.measure_column(df, ["qty"]) == "amount"
    assert columns.measure_column(df.drop("amount"), ["qty"]) is None
    assert columns.measure_column(df.withColumn("qty", F.lit("1")), ["quantity", "qty"]) == "qty"


# --- feeds ----------------------------------------------------------------------------------------
def test_sku_feed(spark, tmp_path):
    path = put(tmp_path / "sku.csv", " Product_ID ,Title\n007,mug\n,ghost\n8,\n")
    assert sorted(rows(feeds.load_sku(spark, path)), key=str) == [("007", "mug"), ("8", None)]
    with pytest.raises(ValueError):
        feeds.load_sku(spark, path, "batch")
    strict = put(tmp_path / "s2.csv", "SKU_ID,Display_Name,x\n1,cup,9\n")
    assert rows(feeds.load_sku(spark, strict, "batch")) == [("1", "cup")]
    bare = put(tmp_path / "s3.csv", "id\n5\n")
    assert rows(feeds.load_sku(spark, bare)) == [("5", "5")]
    assert feeds.load_sku(spark, str(tmp_path / "absent.csv")).columns == ["sku_id", "display_name"]
    with pytest.raises(Exception):
        feeds.load_sku(spark, str(tmp_path / "absent.csv"), "batch").collect()


def test_price_feed(spark, tmp_path):
    path = put(tmp_path / "price.csv", "sku,MRP,Sale_Price\n1,10.5,9\n2,bad,8\n")
    assert rows(feeds.load_prices(spark, path)) == [("1", 10.5, 9.0), ("2", None, 8.0)]
    only = put(tmp_path / "p2.csv", "sku_id,price\n1,10\n")
    assert rows(feeds.load_prices(spark, only)) == [("1", 10.0, 10.0)]
    none = put(tmp_path / "p3.csv", "sku_id,selling_price\n1,10\n")
    assert rows(feeds.load_prices(spark, none)) == [("1", None, 10.0)]
    assert rows(feeds.load_prices(spark, none, "batch")) == [("1", 10.0)]
    assert feeds.load_prices(spark, str(tmp_path / "absent.csv")).count() == 0


def test_quantity_feeds(spark, tmp_path):
    stock = put(tmp_path / "inv.csv", "catalog_ref_id,stock_level\n1,5\n1,x\n")
    assert rows(feeds.load_inventory(spark, stock).fillna(-1.0)) == [("1", -1.0), ("1", 5.0)]
    assert feeds.load_inventory(spark, stock, "batch").columns == ["sku_id", "stock"]
    orders = put(tmp_path / "ord.csv", "item_id,Units_Sold\n1,2\n")
    assert rows(feeds.load_orders(spark, orders)) == [("1", 2.0)]
    unnamed = put(tmp_path / "ord2.csv", "sku_id,note,amount\n1,n,7\n")
    assert rows(feeds.load_orders(spark, unnamed)) == [("1", 7.0)]
    nothing = put(tmp_path / "ord3.csv", "sku_id,note\n1,n\n")
    assert rows(feeds.load_orders(spark, nothing)) == []
    with pytest.raises(ValueError):
        feeds.load_orders(spark, nothing, "batch")
    spark.createDataFrame([(3, 4)], "sku_id int, qty int").write.parquet(str(tmp_path / "o.parquet"))
    assert rows(feeds.load_orders(spark, str(tmp_path / "o.parquet"))) == [("3", 4.0)]


def test_event_feeds(spark, tmp_path):
    events = [{"event_name": "view_item", "items": [{"item_id": "a"}, {"sku_id": "b"}]},
              {"event_name": "add_to_cart", "event_params": {"item_id": "a"}}]
    whole = put(tmp_path / "e.json", json.dumps(events))
    lines = put(tmp_path / "e.jsonl", "\n".join(json.dumps(e) for e in events))
    want = [("a", 1, 1), ("b", 1, 0)]
    assert rows(event_counts(feeds.load_events(spark, whole, multi_line=True))) == want
    assert rows(event_counts(feeds.load_events(spark, lines))) == want
    assert feeds.load_events(spark, str(tmp_path / "absent.json")).count() == 0
    counts = put(tmp_path / "c.json", json.dumps(
        {"a": {"view_item": 3}, "b": {"add_to_cart": 2}}, indent=1))
    assert rows(event_counts_from_map(
        feeds.load_event_counts(spark, counts, whole_files=True))) == [
        ("a", 3, 0), ("b", 0, 2)]


def test_competitor_feed_forms(spark, tmp_path):
    items = [{"name": "mug", "summary": {"z": {"price": 9.5}, "a": {"price": "9.5"},
                                         "q": None, "r": {}}}, {"name": "cup"}]
    for name, body in (("list", items), ("wrapped", {"results": items})):
        path = put(tmp_path / f"{name}.json", json.dumps(body))
        parsed = parse_offers(feeds.load_competitors(spark, path)).orderBy("feed_pos").collect()
        assert [(x["name"], x["competitor_price"], x["competitor_name"]) for x in parsed] == [
            ("mug", 9.5, "z"), ("cup", None, None)]
    assert feeds.load_competitors(spark, str(tmp_path / "absent.json")).count() == 0


def test_keys_written_twice(spark, tmp_path):
    path = put(tmp_path / "twice.json",
               '{"name":"mug","summary":{"s":{"price":1},"t":{"price":5},"s":{"price":7}}}')
    row = parse_offers(feeds.load_competitors(spark, path)).first()
    assert (row["competitor_price"], row["competitor_name"]) == (5.0, "t")
    assert row["all_competitors"] == {"s": "7.0", "t": "5.0"}
    counts = put(tmp_path / "counts.json", '{"a":{"view_item":3},"a":{"view_item":4}}')
    assert rows(event_counts_from_map(feeds.load_event_counts(spark, counts))) == [("a", 4, 0)]


def test_feed_order_goes_over_files(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    for n, price in ((1, 5), (2, 6), (3, 7)):  # the larger file would be read first
        put(folder / f"part{n}.json", json.dumps({"name": "mug", "summary": {
            "s": {"price": price}}, "pad": "x" * 1000 * n}))
    items = feeds.load_competitors(spark, str(folder))
    last = parse_offers(one_item_per(items, "name", "last")).first()
    first = parse_offers(one_item_per(items, "name", "first")).first()
    assert (first["competitor_price"], last["competitor_price"]) == (5.0, 7.0)


def test_whole_folder_to_published_features(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    put(folder / "sku.csv", "sku_id,display_name\n1,mug\n2,cup\n")
    put(folder / "price.csv", "sku_id,list_price\n1,10\n2,20\n")
    put(folder / "inventory.csv", "catalog_ref_id,stock_level\n1,5\n1,6\n2,0\n")
    put(folder / "purchased_order.csv", "catalog_ref_id,quantity\n1,2\n")
    put(folder / "ga4_events.json", json.dumps(
        [{"event_name": "view_item", "items": [{"item_id": "1"}]}]))
    put(folder / "competitor_pricing.json", json.dumps(
        [{"name": "mug", "summary": {"s": {"price": "8"}}}]))
    loaded = feeds.load_all(spark, str(folder))
    for variant in ("service", "batch"):
        master = master_from_feeds(feeds.load_all(spark, str(folder), variant), variant).collect()
        assert [(x["sku_id"], x["total_inventory"], x["price_diff_pct"]) for x in master] == [
            ("1", 11.0, 25.0)]
    path = str(tmp_path / "features")
    counts = event_counts(loaded["events"])
    publish_features(loaded, counts, "whole_1", f"{path}/1")
    publish_features(loaded, counts, "whole_2", f"{path}/2", buckets=3)
    again = reload_features(spark, "whole_2")
    assert again.count() == 1 and again.first()["all_competitors_json"] == {"s": "8.0"}


def test_published_shops_lie_once_a_product(spark, tmp_path):
    n = 40
    shops = {f"site_{k}": {"price": str(k + 1)} for k in range(500)}
    sku = spark.range(n).select(F.col("id").cast("string").alias("sku_id"), F.lit("mug").alias("display_name"))
    extra = spark.createDataFrame([("x", "cup"), ("y", None)], "sku_id string, display_name string")
    sku = sku.unionByName(extra)
    kind = "name string, feed_pos bigint, summary map<string,struct<price:string>>"
    items = spark.createDataFrame([("mug", 0, {"old": {"price": "3"}}), ("mug", 1, shops), ("jar", 2, shops)],
                                  kind)
    loaded = {
        "sku": sku, "price": sku.select("sku_id", F.lit(10.0).alias("list_price")), "competitors": items,
        "orders": sku.select("sku_id", F.lit(1.0).alias("quantity")), "inventory": sku.select("sku_id", F.lit(5.0).alias("stock"))}
    counts = spark.createDataFrame([], "sku_id string, views bigint, add_to_cart bigint")
    publish_features(loaded, counts, "apart_1", f"{tmp_path}/1")
    assert "all_competitors_json" not in spark.table("apart_1").columns  # a list of 500 shops in each row
    held = {x["_item"]: len(x["all_competitors_json"]) for x in spark.table("apart_1_items").collect()}
    assert held == {"mug": 500, "jar": 500}
    maps, texts = ({x["sku_id"]: x["all_competitors_json"] for x in reload_features(spark, "apart_1", t).collect()} for t in (False, True))
    assert len(maps) == n + 2 and maps["x"] is None and maps["y"] is None and texts["x"] is None
    assert all(maps[str(k)] == {f"site_{i}": f"{i + 1}.0" for i in range(500)} for k in range(n))
    assert {k: v and json.loads(v) for k, v in texts.items()} == maps
    one = with_shops(spark.table("apart_1").where("sku_id = '7'"), "apart_1")
    assert one.columns == reload_features(spark, "apart_1").columns and len(one.first()["all_competitors_json"]) == 500
    with pytest.raises(AnalysisException):
        publish_features(loaded, counts, "apart_1", f"{tmp_path}/3")


# --- tables -----------------------------------------------------------------------------------------
GOLDEN = ("sku_id string, extra int, price double, competitor_price double, "
          "inventory_level double, price_diff_pct double, demand_qty double")


def test_golden_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 10.0, None, 5.0, None, 2.0)], GOLDEN)
    table, csv = str(tmp_path / "golden"), str(tmp_path / "golden_csv")
    df.write.parquet(table)
    df.write.csv(csv, header=True)
    primary = tables.load_golden(spark, table, csv)
    assert "extra" not in primary.columns
    assert tuple(primary.first()) == ("a", 10.0, 10.0, 5.0, 0.0, 2.0)
    fallback = tables.load_golden(spark, str(tmp_path / "absent"), csv)
    assert "extra" in fallback.columns and fallback.first()["competitor_price"] == 10.0
    with pytest.raises(ValueError):
        tables.load_golden(spark, None)
    with pytest.raises(Exception):
        tables.load_golden(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        tables.read_golden(spark, table, ["nope"])


def test_file_to_table(spark, tmp_path):
    path = put(tmp_path / "f.csv", "a b,c\n1,x\n2,y\n")
    target = str(tmp_path / "t")
    tables.file_to_table(spark, path, target)
    tables.file_to_table(spark, path, target)
    got = spark.read.parquet(target)
    assert got.columns == ["a_b", "c"] and rows(got) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.file_to_table(spark, str(tmp_path / "f.pdf"), target)


def test_priced_output(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, {"s": "1"})],
                               "sku_id string, new_price double, m map<string,string>")
    run = Run("2024-01-01_000000", "v1", "ABCDEF")
    stamped = stamp(df, run)
    folder = str(tmp_path / "out")
    tables.write_priced(stamped, folder, "rule")
    tables.write_priced(stamp(df, Run("x", "v1", "OTHER1")), folder, "ai")
    back = spark.read.parquet(folder)
    assert back.count() == 2 and back.filter("mode = 'rule'").first()["run_id"] == "ABCDEF"
    for run_id in ("004512", "12E456"):  # text, although it looks like a number
        again = stamp(df, Run("x", "v1", run_id))
        tables.write_priced(again, folder, "rule")
        tables.write_priced(again, folder, "rule")
        got = tables.read_priced(spark, folder, again.schema, "rule", run_id).collect()
        assert [x["run_id"] for x in got] == [run_id]
    target = tables.write_priced_csv(stamped, folder + "_csv", "rule", run.run_date,
                                     run.model_version, run.run_id)
    assert target.endswith("rule_pricing_output_2024-01-01_000000_v1_ABCDEF.csv")
    assert spark.read.csv(target, header=True).first()["m"] == '{"s":"1"}'


def test_a_write_counts_its_nulls(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def count(x):
        counter.add(1)
        return x

    seen = F.udf(count, "double")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, seen(F.col("id").cast("double"))).alias("x"), F.lit(None).cast("string").alias("y"))
    got = tables.write_measured(rows, f"{tmp_path}/t", ["id", "x", "y"])
    assert sorted(map(tuple, got.collect())) == [("id", 0, 1000), ("x", 250, 1000), ("y", 1000, 1000)]
    written = spark.read.parquet(f"{tmp_path}/t")
    assert written.count() == 1000 and counter.value == 1000  # the rows were computed once
    assert sorted(map(tuple, quality.null_report(written, ["id", "x", "y"]).collect())) == sorted(map(tuple, got.collect()))
    none = tables.write_measured(rows.where("id < 0"), f"{tmp_path}/none", ["x"])
    assert [tuple(r) for r in none.collect()] == [("x", 0, 0)]
    with pytest.raises(ValueError):
        tables.write_measured(rows, f"{tmp_path}/u", ["absent"])


def test_published_versions_stay_and_are_laid_out_for_lookups(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("s"), "id").alias("sku_id"), F.map_from_arrays(
        F.array(F.lit("a")), F.array(F.col("id").cast("string"))).alias("m"), "id")
    tables.publish_table(rows, "lookup_1", f"{tmp_path}/1", "sku_id", 8)
    grown = spark.table("lookup_1").unionByName(rows.withColumn("sku_id", F.concat(F.lit("t"), "id")))
    tables.publish_table(grown, "lookup_2", f"{tmp_path}/2", "sku_id", 8)  # a table written from itself
    assert spark.table("lookup_1").count() == 1000 and spark.table("lookup_2").count() == 2000
    with pytest.raises(AnalysisException):
        tables.publish_table(rows, "lookup_1", f"{tmp_path}/3", "sku_id", 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # buckets are skipped either way; the plan says so where scans are by bucket
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in plan(spark.table("lookup_2").where("sku_id = 's7'"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(50).select(F.concat(F.lit("T"), "id").alias("sku_id"), F.col("id").alias("pos"))
        found = find_requested(asked, spark.table("lookup_2"))
        text = plan(found)
        assert found.count() == 50 and "Bucketed: true" in text
        # the requests are hashed to the buckets, and their answers by request; the table isn't
        assert text.count("Exchange hashpartitioning") == 2
        table_side = text[text.index("FileScan parquet") - 400 : text.index("FileScan parquet")]
        assert "Exchange" not in table_side.split("Sort [sku_id")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = find_ids(spark.table("lookup_2"), [" s1 ", "S2", "", "s1", "none"])
    assert sorted((r["requested_id"], r["sku_id"], r["id"]) for r in few.collect()) == [("S2", "s2", 2), ("s1", "s1", 1)]
    assert "out of 8" in plan(few) and "SelectedBucketsCount: 8 out of 8" not in plan(few)
    with pytest.raises(ValueError):
        find_ids(spark.table("lookup_2"), ["x"] * 501)
    spark.sql("DROP TABLE lookup_2")  # an external table: the rows stay
    again = tables.declare_table(spark, "lookup_3", f"{tmp_path}/2", "sku_id", 8)
    assert again.count() == 2000 and "SelectedBucketsCount: 1 out of 8" in plan(again.where("sku_id = 't7'"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_shared_folder_is_the_one_of_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_folder(spark) == folder
    copy = tables.materialized(spark.range(4), "four")
    assert copy.count() == 4 and copy.inputFiles()[0].startswith(f"file://{folder}/four_")
