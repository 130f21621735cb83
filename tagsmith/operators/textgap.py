"""Search-query gap analysis: clean texts, classify intents, find unmet demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.functions.text import clean_query
from tagsmith.operators.intents import IntentModel, predict_intents


def clean_queries(queries: DataFrame, text_col: str = "search_query") -> DataFrame:
    return queries.withColumn(text_col, clean_query(F.col(text_col)))


def confident(predictions: DataFrame,
              threshold: float = fv.INTENT_MIN_CONFIDENCE) -> DataFrame:
    """Low-confidence predictions are ignored; each query keeps its single intent."""
    return predictions.filter(F.col("confidence_score") >= threshold)


def gaps(silver: DataFrame, sku_attributes: DataFrame) -> DataFrame:
    """Queries whose intent no SKU offers: (sku, standard_attribute_key) pairs not in the
    catalogue. The catalogue is reduced to its distinct pairs before it is shuffled."""
    keys = ["sku", "standard_attribute_key"]
    offered = sku_attributes.select(*keys).distinct()
    return silver.join(offered, keys, "left_anti").select(*fv.GAP_COLUMNS)


def gap_counts(gap_rows: DataFrame) -> DataFrame:
    """Unmet demand per intent."""
    return gap_rows.groupBy("standard_attribute_key").agg(
        F.count(F.lit(1)).alias("gap_queries"),
        F.count_distinct("sku").alias("skus_affected"))


def write_gap_tables(bronze: DataFrame, model: IntentModel, sku_attributes: DataFrame,
                     bronze_path: str, silver_path: str, gaps_path: str,
                     threshold: float = fv.INTENT_MIN_CONFIDENCE) -> None:
    """bronze (as received) to silver (cleaned, confident) to gaps. Each step reads the table
    the step before has written, so a lost run resumes from a table."""
    spark = bronze.sparkSession
    bronze.write.mode("overwrite").parquet(bronze_path)
    cleaned = clean_queries(spark.read.parquet(bronze_path))
    silver = confident(predict_intents(model, cleaned), threshold).select(*fv.GAP_COLUMNS)
    silver.write.mode("overwrite").parquet(silver_path)
    gaps(spark.read.parquet(silver_path), sku_attributes).write.mode("overwrite").parquet(
        gaps_path)
