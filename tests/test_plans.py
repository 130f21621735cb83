"""What the physical plans must and must not contain, and skewed keys."""

import pytest
from pyspark.sql import functions as F

from tagsmith.operators.features import first_per_key, match_offers_to_skus, sku_sales
from tagsmith.workload import roles as r
from tagsmith.workload.queries import registered

LAZY = [n for n in registered() if not n.startswith(("train_", "tune_", "stream_", "time_split"))
        and n not in ("sweep_mllib", "intent_classifier", "feature_importances", "gap_chain")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _windows_without_keys(text):
    """Window specifications whose first entry is already an ordering."""
    found = [line.split("windowspecdefinition(")[1] for line in text.splitlines()
             if "windowspecdefinition(" in line]
    return [spec for spec in found if "," not in spec.split(" ASC")[0].split(" DESC")[0]]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_no_python_no_whole_table_windows(spark, sf, name):
    text = plan(registered()[name](spark, sf))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython",
                     "BatchEvalPython", "MapInPandas"):
        assert operator not in text, operator
    assert not _windows_without_keys(text)


def test_scans_read_only_needed_columns(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(registered()["inventory_totals"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} <= {
        "l_partkey", "l_suppkey", "l_quantity"}
    assert "EqualTo(quality,1)" in plan(registered()["gap_counts"](spark, sf))


@pytest.mark.parametrize("name", ["request_pricing", "missing_requests", "request_summary"])
def test_requests_read_the_published_table_only(spark, sf, name):
    frame = registered()[name](spark, sf)
    assert plan(frame).count("FileScan parquet") <= 4
    assert {("published" if "/published_" in f else f.rsplit("/", 1)[1])
            for f in frame.inputFiles()} <= {"published", "orders.parquet"}


def test_top_row_per_key_is_trimmed_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(first_per_key(df, ["k"], [F.col("id")]))
    before_shuffle = text.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_demand_maxima_reuse_the_aggregates(spark, sf):
    frame = registered()["demand_score"](spark, sf)
    frame.collect()
    assert "ReusedExchange" in plan(frame)


def test_sku_master_is_hashed_once_per_input(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(r.master(spark, sf)).split("Subquery subquery")[0]
        keyed = [line for line in text.splitlines() if "Exchange hashpartitioning(sku_id" in line]
        assert len(keyed) <= 6  # price, stock, sales, events, offers, names
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_sku_is_added_up_before_the_shuffle(spark):
    lines = spark.range(0, 300000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sku_id"),
        F.lit(1.0).alias("quantity"))
    got = sku_sales(lines)
    assert got.filter("sku_id = 'hot'").first()["total_sales"] == 100000.0
    assert got.count() == 200001
    text = plan(sku_sales(lines))
    assert "partial_sum" in text.split("Exchange hashpartitioning")[1]


def test_a_hot_name_is_matched_whole(spark):
    """A third of all SKUs share a name; the join may be split, the result may not change."""
    sku = spark.range(0, 60000, 1, 6).select(
        F.col("id").cast("string").alias("sku_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), "id"))
        .alias("display_name"))
    offers = spark.createDataFrame([("hot", 1.0), ("n1", 2.0), ("gone", 3.0)],
                                   "name string, competitor_price double")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        matched = match_offers_to_skus(offers, sku)
        got = matched.collect()
        assert "skew=true" in plan(matched)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(x["competitor_price"] == 1.0 for x in got) == 20000
    assert sorted((x["sku_id"] or "") for x in got if x["competitor_price"] > 1) == ["", "1"]
