"""Model metrics as one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.functions.numeric import ratio, round_to
from tagsmith.operators.ordering import running_total


def _clean(c: Column) -> Column:
    """Metrics that cannot be computed are zero."""
    usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(usable, c).otherwise(F.lit(0.0))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       min_r2: float = fv.GATE_MIN_R2,
                       max_mae: float = fv.GATE_MAX_MAE) -> DataFrame:
    """r2, mae, mape (actual + 1 below), rmse, pseudo accuracy and the quality gate, one pass.

    No row is left out of a relative error: pseudo accuracy is null if an actual is zero
    (`zero_actuals` counts them), mape is zero, as any metric that can't be computed, if one is -1.
    """
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = F.abs(y - p)
    sums = df.agg(
        F.avg(error).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(y).alias("spread"),
        F.when(F.count_if(y == -1.0) == 0, F.avg(F.abs(ratio(y - p, y + 1.0)))).alias("mape"),
        F.count_if(y == 0.0).alias("zero_actuals"),
        F.when(F.count_if(y == 0.0) == 0, F.avg(F.abs(ratio(y - p, y)))).alias("relative"))
    r2 = _clean(F.lit(1.0) - ratio(F.col("mse"), F.col("spread")))
    shaped = sums.select(
        round_to(r2, 6).alias("r2"), round_to(_clean(F.col("mae")), 6).alias("mae"),
        round_to(_clean(F.col("mape") * 100.0), 6).alias("mape"),
        round_to(F.sqrt("mse"), 6).alias("rmse"),
        round_to(F.lit(100.0) - F.col("relative") * 100.0, 6).alias("pseudo_accuracy"),
        "zero_actuals")
    return shaped.withColumn(
        "passes_gate", (F.col("r2") >= min_r2) & (F.col("mae") <= max_mae))


def actual_vs_predicted(scored: DataFrame, key: str, actual: str,
                        predicted: str = "prediction") -> DataFrame:
    return scored.select(key, F.col(actual).cast("double").alias("actual"),
                         F.col(predicted).cast("double").alias("predicted"))


def area_under_roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC area by rank sums; equal scores share their average rank.

    Rows are counted per distinct score first, so a frequent score is one row, and ranks come
    from the range-wise running total, not from a window over everything.
    """
    per_score = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"))
    ranked = running_total(per_score, "score", ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    sums = ranked.agg(F.sum(rank * F.col("positives")).alias("rank_sum"),
                      F.sum("positives").cast("double").alias("pos"),
                      F.sum(F.col("n") - F.col("positives")).cast("double").alias("neg"))
    lead = F.col("rank_sum") - F.col("pos") * (F.col("pos") + 1.0) / 2.0
    return sums.select(ratio(lead, F.col("pos") * F.col("neg")).alias("roc_auc"))


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                           score: str | None = None) -> DataFrame:
    """Accuracy, support-weighted F1 and, with scores, ROC area."""
    cells = df.groupBy(F.col(actual).alias("y"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("guessed"), hit.alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hits")))
    per_class = (cells.select(F.explode(sides).alias("s")).groupBy("s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"),
        F.sum("s.hits").alias("hits")))
    f1 = F.col("hits") * 2.0 / (F.col("support") + F.col("guessed"))
    metrics = per_class.agg(
        round_to(F.sum("hits") / F.sum("support"), 6).alias("accuracy"),
        round_to(F.sum(f1 * F.col("support")) / F.sum("support"), 6).alias("f1"))
    if score is None:
        return metrics
    return metrics.withColumn(
        "roc_auc", round_to(area_under_roc(df, actual, score).scalar(), 6))
