"""Revenue comparisons at unchanged demand: per-row columns and one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.numeric import exact_total, pct_change, round_to
from tagsmith.operators.demand_models import model_features
from tagsmith.operators.quality import require_columns

PRICE_COLUMNS = ["final_price", "ai_optimal_price", "new_price"]


def chosen_price_column(df: DataFrame) -> str:
    require_columns(df, ["demand_qty"])
    name = next((c for c in PRICE_COLUMNS if c in df.columns), None)
    if name is None:
        raise ValueError(f"no price column: one of {PRICE_COLUMNS} is needed")
    return name


def _pct_or_zero(change: Column, base: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise(
        change / F.nullif(base, F.lit(0.0)) * 100.0)


def _compare(df: DataFrame, old: Column, new: Column, names: tuple[str, str, str, str]):
    """Adds old and new revenue, their difference and its percentage (zero on zero)."""
    old_name, new_name, change, pct = names
    rows = df.withColumns({old_name: old, new_name: new})
    rows = rows.withColumn(change, F.col(new_name) - F.col(old_name))
    return rows.withColumn(pct, round_to(_pct_or_zero(F.col(change), F.col(old_name)), 2))


def _summary(df: DataFrame, old: Column, new: Column,
             names: tuple[str, str, str, str]) -> DataFrame:
    """One row of totals, two decimals, from a single aggregation."""
    old_name, new_name, change, pct = names
    totals = df.agg(F.coalesce(exact_total(old), F.lit(0.0)).alias("o"),
                    F.coalesce(exact_total(new), F.lit(0.0)).alias("n"))
    diff = F.col("n") - F.col("o")
    return totals.select(
        round_to(F.col("o"), 2).alias(old_name), round_to(F.col("n"), 2).alias(new_name),
        round_to(diff, 2).alias(change),
        round_to(_pct_or_zero(diff, F.col("o")), 2).alias(pct))


def _current() -> Column:
    return F.col("current_price") * F.col("demand_qty")


_IMPACT = ("current_revenue", "simulated_revenue", "revenue_change", "revenue_change_pct")


def revenue_impact(df: DataFrame) -> DataFrame:
    """Per-row revenue at the current and at the chosen price."""
    return _compare(df, _current(), F.col(chosen_price_column(df)) * F.col("demand_qty"), _IMPACT)


def revenue_impact_summary(df: DataFrame) -> DataFrame:
    names = ("current_revenue", "new_revenue", "revenue_change", "revenue_change_pct")
    return _summary(df, _current(), F.col(chosen_price_column(df)) * F.col("demand_qty"), names)


def current_vs_ai_summary(df: DataFrame) -> DataFrame:
    require_columns(df, ["demand_qty", "ai_optimal_price"])
    names = ("current_revenue", "ai_revenue", "revenue_change", "revenue_change_pct")
    return _summary(df, _current(), F.col("ai_optimal_price") * F.col("demand_qty"), names)


def ai_vs_rule(df: DataFrame) -> DataFrame:
    names = ("rule_revenue", "ai_revenue", "revenue_lift", "revenue_lift_pct")
    return _compare(df, F.col("new_price") * F.col("demand_qty"),
                    F.col("ai_optimal_price") * F.col("demand_qty"), names)


def ai_vs_rule_summary(df: DataFrame) -> DataFrame:
    names = ("rule_revenue", "ai_revenue", "revenue_lift", "lift_pct")
    return _summary(df, F.col("new_price") * F.col("demand_qty"),
                    F.col("ai_optimal_price") * F.col("demand_qty"), names)


def revenue_lift(df: DataFrame, current: str, new: str, quantity: str) -> DataFrame:
    """Totals and lift; the percentage is zero unless current revenue is positive."""
    totals = df.agg(
        F.coalesce(exact_total(F.col(current) * F.col(quantity)), F.lit(0.0)).alias("o"),
        F.coalesce(exact_total(F.col(new) * F.col(quantity)), F.lit(0.0)).alias("n"))
    diff = F.col("n") - F.col("o")
    pct = F.when(F.col("o") > 0, diff / F.nullif(F.col("o"), F.lit(0.0)) * 100.0).otherwise(0.0)
    return totals.select(
        round_to(F.col("o"), 2).alias("current_revenue"),
        round_to(F.col("n"), 2).alias("new_revenue"),
        round_to(diff, 2).alias("revenue_lift"), round_to(pct, 2).alias("lift_pct"))


# --- champion and challenger ------------------------------------------------------------------
def score_champion_challenger(df: DataFrame, champion=None, challenger=None) -> DataFrame:
    """Demand (not clipped) and revenue of two models at the current price.

    Without both models the four columns are NULL.
    """
    names = ["champion_demand", "challenger_demand"]
    if champion is None or challenger is None:
        rows = df.withColumns({n: F.lit(None).cast("double") for n in names})
    else:
        rows = champion.score(df, names[0], model_features())
        rows = challenger.score(rows, names[1], model_features())
    return rows.withColumns({
        "champion_revenue": F.col("champion_demand") * F.col("current_price"),
        "challenger_revenue": F.col("challenger_demand") * F.col("current_price"),
    })


def champion_challenger_summary(df: DataFrame) -> DataFrame:
    """Totals to a millionth, lift and its percentage (zero unless the champion earns)."""
    totals = df.agg(exact_total(F.col("champion_revenue")).alias("champion_revenue"),
                    exact_total(F.col("challenger_revenue")).alias("challenger_revenue"))
    lift = F.col("challenger_revenue") - F.col("champion_revenue")
    pct = pct_change(F.col("challenger_revenue"), F.col("champion_revenue"))
    return totals.select(
        "champion_revenue", "challenger_revenue", lift.alias("revenue_lift"),
        F.when(F.col("champion_revenue") > 0, pct)
        .when(F.col("champion_revenue").isNotNull(), F.lit(0.0)).alias("lift_pct"))


# --- all strategies side by side -----------------------------------------------------------------
def strategy_dashboard(df: DataFrame) -> DataFrame:
    """(metric, value) rows for every strategy the frame carries, from one aggregation.

    `chosen` is the price that the run settled on, `rule` the one of the rules.
    """
    has_ai = "ai_optimal_price" in df.columns
    has_rule = "new_price" in df.columns
    has_pair = "champion_revenue" in df.columns
    quantity = F.col("demand_qty")
    sums = {"cur": _current(), "chosen": F.col(chosen_price_column(df)) * quantity}
    if has_rule:
        sums["rule"] = F.col("new_price") * quantity
    if has_ai:
        sums["ai"] = F.col("ai_optimal_price") * quantity
    if has_pair:
        sums["champ"], sums["chall"] = F.col("champion_revenue"), F.col("challenger_revenue")
    totals = df.agg(*[F.coalesce(exact_total(c), F.lit(0.0)).alias(n) for n, c in sums.items()])

    def total(n: str) -> Column:
        return round_to(F.col(n), 2)

    def lift(new: str, old: str) -> Column:
        return round_to(F.col(new) - F.col(old), 2)

    def lift_pct(new: str, old: str) -> Column:
        return round_to(_pct_or_zero(F.col(new) - F.col(old), F.col(old)), 2)

    metrics = {
        "current_revenue": total("cur"), "chosen_revenue": total("chosen"),
        "chosen_vs_current_change": lift("chosen", "cur"),
        "chosen_vs_current_pct": lift_pct("chosen", "cur"),
    }
    if has_rule:
        metrics |= {
            "rule_revenue": total("rule"), "rule_vs_current_change": lift("rule", "cur"),
            "rule_vs_current_pct": lift_pct("rule", "cur"),
        }
    if has_ai:
        metrics |= {
            "ai_revenue": total("ai"), "ai_vs_current_lift": lift("ai", "cur"),
            "ai_vs_current_pct": lift_pct("ai", "cur"),
        }
    if has_ai and has_rule:
        metrics |= {"ai_vs_rule_lift": lift("ai", "rule"), "ai_vs_rule_pct": lift_pct("ai", "rule")}
    if has_pair:
        metrics |= {
            "champion_revenue": total("champ"), "challenger_revenue": total("chall"),
            "challenger_lift": lift("chall", "champ"),
            "challenger_lift_pct": lift_pct("chall", "champ"),
        }
    wide = totals.select(F.lit(0).alias("_id"), *[c.alias(n) for n, c in metrics.items()])
    return wide.unpivot("_id", list(metrics), "metric", "value").drop("_id")
