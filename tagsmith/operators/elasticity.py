"""Per-SKU price elasticity.

The fit samples demand = base_demand * base_price / price on a grid around the base price and
lays a least-squares line through it. Scaled by base price and base demand, every SKU has the
same grid, so slope, intercept and residuals are constants times the two base values. They are
worked out once from the grid below; the table then needs one projection and no grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.functions.numeric import price_grid, real, round_to
from tagsmith.operators.features import sku_sales
from tagsmith.operators.sweep import with_best_candidate


def training_rows(master: DataFrame, orders: DataFrame) -> DataFrame:
    """SKUs with sales and their ordered quantity."""
    sold = sku_sales(orders, "demand_qty").filter(F.col("demand_qty") > 0)
    return master.drop("demand_qty").join(sold, "sku_id", "inner").select(
        "sku_id", "current_price", "demand_qty", "competitor_price", "inventory_bucket")


def base_point(rows: DataFrame) -> DataFrame:
    """One base price and demand per SKU: the row with the lowest price."""
    point = F.struct("current_price", "demand_qty")
    return rows.groupBy("sku_id").agg(F.min(point).alias("base")).select("sku_id", "base.*")


def _unit_fit(steps: int, low: float, high: float):
    """Line and residuals for base price 1 and base demand 1."""
    xs = [low + k * (high - low) / (steps - 1) for k in range(steps)]
    ys = [1.0 / x for x in xs]
    mx, my = sum(xs) / steps, sum(ys) / steps
    slope = (sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs))
    intercept = my - slope * mx
    residuals = [abs(y - (intercept + slope * x)) for x, y in zip(xs, ys)]
    r2 = 1.0 - sum(r * r for r in residuals) / sum((y - my) ** 2 for y in ys)
    return slope, intercept, r2, ys, residuals


def _fit_columns(price: Column, demand: Column, steps: int, low: float,
                 high: float) -> dict[str, Column]:
    slope, intercept, r2, ys, residuals = _unit_fit(steps, low, high)
    samples = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(y).alias("y"))
                        for r, y in zip(residuals, ys)])
    relative = F.aggregate(samples, F.lit(0.0),
                           lambda acc, s: acc + s["r"] * demand / (s["y"] * demand + 1.0))
    usable = (demand > 0) & (price != 0)
    return {
        "slope": F.when(usable, F.lit(slope) * demand / F.nullif(price, F.lit(0.0))),
        "intercept": F.when(usable, F.lit(intercept) * demand),
        "elasticity_r2": F.when(usable, F.lit(round(r2, 4))),
        "elasticity_mae": F.when(usable, round_to(F.lit(sum(residuals) / steps) * demand, 2)),
        "elasticity_mape": F.when(usable, round_to(relative / steps * 100.0, 2)),
    }


def fit(points: DataFrame, steps: int = fv.ELASTICITY_FIT_STEPS, low: float = fv.SWEEP_LOW,
        high: float = fv.SWEEP_HIGH) -> DataFrame:
    """Slope, intercept, elasticity_r2, elasticity_mae, elasticity_mape of every base point.

    SKUs without demand or price get no row.
    """
    price, demand = real(F.col("current_price")), real(F.col("demand_qty"))
    fitted = points.withColumns(_fit_columns(price, demand, steps, low, high))
    return fitted.filter((demand > 0) & (price != 0)).select(
        "sku_id", F.col("current_price").alias("base_price"),
        F.col("demand_qty").alias("base_demand"), "slope", "intercept", "elasticity_r2",
        "elasticity_mae", "elasticity_mape")


def with_own_fit(rows: DataFrame, steps: int = fv.ELASTICITY_FIT_STEPS,
                 low: float = fv.SWEEP_LOW, high: float = fv.SWEEP_HIGH) -> DataFrame:
    """The same columns put on a frame that already has one row per SKU with its demand, with
    no grouping and no join; NULL where there is no fit."""
    price, demand = real(F.col("current_price")), real(F.col("demand_qty"))
    return rows.withColumns(_fit_columns(price, demand, steps, low, high))


def optimal_price(rows: DataFrame, steps: int = fv.ELASTICITY_PRICE_STEPS) -> DataFrame:
    """Adds elasticity_price, the revenue-best price on the fitted line (columns slope and
    intercept); rows without a fit keep the current price."""
    price = F.col("current_price")

    def revenue(p: Column, index: Column) -> Column:
        return p * F.greatest(F.col("intercept") + F.col("slope") * p, F.lit(0.0))

    swept = with_best_candidate(
        rows.withColumn("_grid", price_grid(price, steps, fv.SWEEP_LOW, fv.SWEEP_HIGH)),
        "_grid", revenue, F.lit(0.0))
    best = F.when(F.col("slope").isNull(), price).otherwise(
        round_to(F.coalesce(F.col("_best"), price), 2))
    return swept.select(*rows.columns, best.alias("elasticity_price"))


def with_fit(master: DataFrame, fits: DataFrame) -> DataFrame:
    """Master rows with the line and the quality of their stored fit, NULL where there is none."""
    return master.join(fits.drop("base_price", "base_demand"), "sku_id", "left")
