"""Rule pricing. Both rule sets are one `when` chain; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.functions.numeric import real, round_to


def _decision(price: Column, reason: Column | str, alert: bool = False, **more: str) -> Column:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    extra = [F.lit(v).alias(k) for k, v in more.items()]
    return F.struct(price.alias("new_price"), text.alias("decision_reason"),
                    F.lit(alert).alias("alert_flag"), *extra)


def _match_text() -> Column:
    return F.concat(F.lit(fv.MATCH_PREFIX), F.coalesce(F.col("competitor_name"), F.lit("")))


def batch_rules(master: DataFrame) -> DataFrame:
    """Adds new_price, decision_reason and alert_flag by stock, demand and competitor bands."""
    price, rival = F.col("current_price"), real(F.col("competitor_price"))
    gap = real(F.col("price_diff_pct"))
    stock, demand = F.col("inventory_bucket"), F.col("demand_bucket")
    position = F.col("competitor_bucket")
    has_rival = rival.isNotNull() & (rival != 0)
    scarce = (demand == "HIGH") & (stock == "LOW")

    choice = (
        F.when((gap > 5) | (gap < -5), _decision(price, fv.REVIEW_GAP, True))
        .when(gap.between(-2, 2) & has_rival, _decision(rival * 0.999, fv.AUTO_MATCH))
        .when((stock == "VERY_HIGH") & (demand == "LOW"), _decision(price * 0.70, fv.CLEARANCE))
        .when((position == "NO_COMPETITOR") & (demand == "HIGH") & stock.isin("LOW", "MED"),
              _decision(price * 1.25, fv.MONOPOLY))
        .when(scarce & (position == "WE_CHEAPER"), _decision(price * 1.20, fv.BIG_INCREASE))
        .when(scarce & (position == "SAME"), _decision(price * 1.10, fv.INCREASE))
        .when((position == "COMPETITOR_CHEAPER") & has_rival,
              _decision(rival * 0.99, _match_text()))
        .otherwise(_decision(price, fv.NO_CHANGE))
    )
    return _spread(master, choice, ["new_price", "decision_reason", "alert_flag"])


def service_rules(master: DataFrame, alert_gap: float = fv.SERVICE_ALERT_GAP) -> DataFrame:
    """Adds the same columns and pricing_reason by competitor price alone."""
    price, rival = F.col("current_price"), real(F.col("competitor_price"))
    gap = real(F.col("price_diff_pct"))
    has_rival = rival > 0
    distance = F.abs((price - rival) / F.nullif(rival, F.lit(0.0)) * 100)

    choice = (
        F.when(has_rival & (F.abs(gap) > alert_gap),
               _decision(price, fv.REVIEW_GAP, True, pricing_reason="RULE_OVERRIDE_ALERT"))
        .when(has_rival & (distance <= 0.1),
              _decision(round_to(rival, 2), fv.AUTO_MATCH, pricing_reason="RULE_AUTO_MATCH"))
        .when(has_rival, _decision(round_to(rival * 0.999, 2), _match_text(),
                                   pricing_reason="RULE_MATCH_COMPETITOR"))
        .otherwise(_decision(price, fv.NO_COMPETITOR_DATA, pricing_reason="NO_COMPETITOR"))
    )
    return _spread(master, choice,
                   ["new_price", "decision_reason", "alert_flag", "pricing_reason"])


def _spread(master: DataFrame, choice: Column, names: list[str]) -> DataFrame:
    kept = [c for c in master.columns if c not in names]
    return master.select(*kept, choice.alias("_choice")).select(
        *kept, *[F.col(f"_choice.{n}").alias(n) for n in names])
