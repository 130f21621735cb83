"""Business labels (buckets, scores) as `when` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagsmith.functions.numeric import real, ratio, round_to


def demand_score(sales: Column, carts: Column, views: Column) -> Column:
    """Weighted demand signal; inputs are already scaled to their maxima."""
    return F.lit(0.5) * sales + F.lit(0.3) * carts + F.lit(0.2) * views


def demand_label(score: Column) -> Column:
    return F.when(score > 0.7, "HIGH").when(score > 0.4, "MED").otherwise("LOW")


def stock_label(stock: Column) -> Column:
    """Feature-table bands, strict bounds."""
    return (
        F.when(stock > 1000, "VERY_HIGH").when(stock > 400, "HIGH").when(stock > 100, "MED")
        .otherwise("LOW")
    )


def result_stock_label(stock: Column) -> Column:
    """Result-table bands, inclusive bounds."""
    return (
        F.when(stock >= 500, "VERY_HIGH").when(stock >= 200, "HIGH").when(stock >= 50, "MED")
        .otherwise("LOW")
    )


def result_demand_label(quantity: Column) -> Column:
    return F.when(quantity > 5.0, "HIGH").otherwise("LOW")


def competitor_label(list_price: Column, competitor_price: Column) -> Column:
    """Feature-table position; an unknown list price compares as SAME."""
    return (
        F.when(competitor_price.isNull(), "NO_COMPETITOR")
        .when(competitor_price < list_price, "COMPETITOR_CHEAPER")
        .when(competitor_price > list_price, "WE_CHEAPER")
        .otherwise("SAME")
    )


def result_competitor_label(our_price: Column, competitor_price: Column) -> Column:
    """Result-table position with a two percent band."""
    gap = ratio(our_price - competitor_price, competitor_price) * 100.0
    return (
        F.when(competitor_price.isNull() | (competitor_price <= 0), "NO_COMPETITOR")
        .when(F.abs(gap) <= 2, "SAME")
        .when(gap < -2, "WE_CHEAPER")
        .otherwise("COMPETITOR_CHEAPER")
    )


def price_gap_pct(list_price: Column, competitor_price: Column) -> Column:
    """How far our list price is above the competitor, in percent, two decimals."""
    return round_to(ratio(list_price - competitor_price, competitor_price) * 100.0, 2)


def confidence_score(competitor: Column, stock: Column, demand: Column, views: Column,
                     carts: Column, change_pct: Column) -> Column:
    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    total = (
        points(real(competitor) > 0, 0.25)
        + points(stock >= 50, 0.20)
        + points(demand > 1.0, 0.20)
        + points((views > 0) | (carts > 0), 0.15)
        + points(F.abs(change_pct) < 10.0, 0.20)
    )
    return round_to(F.least(total, F.lit(1.0)), 4)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.70, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")
