"""Price sweep: try a grid of prices per SKU and keep the one with most revenue.

The grid is an array inside the row, revenues are a `transform` of it and the best candidate is
`array_max` plus `array_position`. There is no explode, no group-by and no shuffle. (Fifteen
unrolled candidate columns were measured too and took three to six times as long, probably
because the generated method is then too long for the JIT.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.functions.numeric import or_default, pct_change, price_grid, real, round_to


def with_best_candidate(df: DataFrame, grid: str, revenue, base: Column) -> DataFrame:
    """Adds _top (highest revenue, at least `base`) and _best (its price, NULL when no candidate
    earns more than `base`).

    `revenue` maps (price, index) to the candidate's revenue, NULL for candidates not allowed.
    Of equal revenues the first candidate counts.
    """
    rows = df.withColumn("_revenues", F.transform(grid, revenue))
    rows = rows.withColumn("_top", F.array_max("_revenues"))
    at = F.array_position("_revenues", F.col("_top")).cast("int")
    better = F.col("_top") > base
    return rows.withColumns({
        "_best": F.when(better, F.element_at(F.col(grid), at)),
        "_top": F.when(better, F.col("_top")).otherwise(base),
    })


def base_demand(baseline: str) -> Column:
    """Demand that the current price is credited with.

    `batch`: missing or zero counts as one; `service`: as it is; `single`: at least 0.1.
    """
    quantity = real(F.col("demand_qty"))
    if baseline == "batch":
        return or_default(quantity, F.lit(1.0))
    if baseline == "service":
        return F.coalesce(quantity, F.lit(0.0))
    if baseline == "single":
        return F.greatest(F.coalesce(quantity, F.lit(0.0)), F.lit(0.1))
    raise ValueError(f"unknown baseline {baseline!r}: batch, service or single")


def sweep_prices(df: DataFrame, model, baseline: str = "batch", tolerance: float = fv.TOLERANCE,
                 steps: int = fv.SWEEP_STEPS, low: float = fv.SWEEP_LOW,
                 high: float = fv.SWEEP_HIGH) -> DataFrame:
    """Adds ai_optimal_price and pricing_reason.

    Rows under alert keep the rule price. Candidates above the competitor are not tried; with
    no competitor the current price is the ceiling. The price gap is held at its current value
    while the price moves, as the model was trained.
    """
    price = F.col("current_price")
    given = real(F.col("competitor_price"))
    # The batch form also replaces a zero competitor price; elsewhere zero means "no ceiling".
    rival = or_default(given, price) if baseline == "batch" else F.coalesce(given, price)
    rows = df.withColumns({
        "_rival": rival,
        "_ceiling": F.when(rival == 0, F.lit(float("inf"))).otherwise(rival),
        "_stock": F.coalesce(real(F.col("total_inventory")), F.lit(0.0)),
        "_gap": F.coalesce(real(F.col("price_diff_pct")), F.lit(0.0)),
        "_base": price * base_demand(baseline),
    })
    rows = rows.withColumn("_grid", price_grid(price, steps, low, high))
    rest = (F.col("_rival"), F.col("_stock"), F.col("_gap"))
    rows, demand = model.score_grid(rows, "_grid", steps, rest)

    def revenue(p: Column, index: Column) -> Column:
        return F.when(p <= F.col("_ceiling"),
                      p * F.greatest(real(demand(p, index)), F.lit(0.0)))

    rows = with_best_candidate(rows, "_grid", revenue, F.col("_base"))
    found = F.col("_best").isNotNull()
    change = (F.col("_top") - F.col("_base")) / F.nullif(F.col("_base"), F.lit(0.0))
    rejected = (F.col("_base") > 0) & (change < -tolerance)
    result = (
        F.when(F.coalesce(F.col("alert_flag"), F.lit(False)),
               _result(F.coalesce(F.col("new_price"), price), F.lit("RULE_OVERRIDE_ALERT")))
        .when(rejected, _result(price, F.lit("REJECTED_LOW_REVENUE")))
        .when(found, _result(round_to(F.col("_best"), 2), F.lit("AI_REVENUE_OPTIMIZED")))
        .otherwise(_result(round_to(price, 2), F.lit("NO_IMPROVEMENT")))
    )
    kept = [c for c in df.columns if c not in ("ai_optimal_price", "pricing_reason")]
    return rows.select(*kept, result.alias("_result")).select(
        *kept, F.col("_result.price").alias("ai_optimal_price"),
        F.col("_result.reason").alias("pricing_reason"))


def _result(price: Column, reason: Column) -> Column:
    return F.struct(price.alias("price"), reason.alias("reason"))


def ai_output(df: DataFrame, model, variant: str = "batch",
              tolerance: float = fv.TOLERANCE) -> DataFrame:
    """Sweep plus ai_strategy and price_change_pct, on a frame that the rules have priced.

    The two variants spell the strategy differently and credit demand differently.
    """
    label = "AI_OPTIMIZED" if variant == "batch" else "AI_OPTIMISED"
    swept = sweep_prices(df, model, baseline=variant, tolerance=tolerance)
    return swept.withColumns({
        "ai_strategy": F.when(F.col("alert_flag"), "RULE_OVERRIDE").otherwise(label),
        "price_change_pct": round_to(
            pct_change(F.col("ai_optimal_price"), F.col("current_price")), 2),
    })
