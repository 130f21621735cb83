"""Bridges between the golden training table and the pricing frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.labels import competitor_label, demand_label, stock_label
from tagsmith.functions.numeric import real
from tagsmith.operators.features import sku_sales


def golden_to_pricing(golden: DataFrame) -> DataFrame:
    """Pricing columns from golden ones: renamed measures plus the three bands.

    The demand band is that of the quantity's share of the largest quantity.
    """
    top = golden.agg(F.max("demand_qty")).scalar()
    rows = golden.withColumnsRenamed({"price": "current_price",
                                      "inventory_level": "total_inventory"})
    share = F.when(top > 0, F.col("demand_qty") / top).otherwise(F.col("demand_qty"))
    return rows.withColumns({
        "list_price": F.col("current_price"),
        "competitor_name": F.lit(None).cast("string"),
        "inventory_bucket": stock_label(F.coalesce(real(F.col("total_inventory")), F.lit(0.0))),
        "demand_bucket": demand_label(share),
        "competitor_bucket": competitor_label(F.col("current_price"),
                                              real(F.col("competitor_price"))),
    })


def master_to_golden(master: DataFrame, orders: DataFrame) -> DataFrame:
    """Golden training rows from the master and the ordered quantities (none sold is zero)."""
    sold = sku_sales(orders, "demand_qty")
    return master.drop("demand_qty").join(sold, "sku_id", "left").select(
        "sku_id", F.col("current_price").alias("price"), "competitor_price",
        F.col("total_inventory").alias("inventory_level"), "price_diff_pct",
        F.coalesce("demand_qty", F.lit(0.0)).alias("demand_qty"))
