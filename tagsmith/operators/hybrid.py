"""Hybrid choice between the rule price and the model price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv


def choose_price(df: DataFrame, min_r2: float = fv.HYBRID_MIN_R2,
                 max_mape: float = fv.HYBRID_MAX_MAPE) -> DataFrame:
    """Adds final_price and pricing_strategy.

    Alerts keep the current price; a good elasticity fit takes the model price; the rest takes
    the rule price. Without fit columns every row counts as having no fit.
    """
    for c in ("elasticity_r2", "elasticity_mape"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    alert = F.coalesce(F.col("alert_flag"), F.lit(False))
    trusted = (F.col("elasticity_r2") >= min_r2) & (F.col("elasticity_mape") <= max_mape)
    return df.withColumns({
        "final_price": F.when(alert, F.col("current_price"))
        .when(trusted, F.col("ai_optimal_price")).otherwise(F.col("new_price")),
        "pricing_strategy": F.when(alert, fv.REVIEW_ALERT)
        .when(trusted, fv.AI_PRICING).otherwise(fv.RULE_PRICING),
    })
