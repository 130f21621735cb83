"""Demand models behind two methods.

`score(df, out, features)` adds demand for one tuple of feature columns: price,
competitor_price, inventory_level, price_diff_pct. `score_grid(df, grid, rest)` serves price
sweeps: it returns the frame and a function `(price, index) -> demand` for the entries of the
array column `grid`, so a sweep stays inside the row, without `explode` and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv

Features = tuple[Column, Column, Column, Column]
GridDemand = Callable[[Column, Column], Column]


def _as_column(value: float | str) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


@dataclass(frozen=True)
class LinearDemand:
    """intercept + weights · features. A weight may be a number or a column name, so per-SKU
    coefficients (for example a fitted price line) work as well."""

    intercept: float | str
    price: float | str = 0.0
    competitor: float | str = 0.0
    inventory: float | str = 0.0
    gap: float | str = 0.0

    def _offset(self, rest: tuple[Column, Column, Column]) -> Column:
        total = _as_column(self.intercept)
        for weight, feature in zip((self.competitor, self.inventory, self.gap), rest):
            if weight != 0.0:
                total = total + _as_column(weight) * feature
        return total

    def score(self, df: DataFrame, out: str, features: Features) -> DataFrame:
        price, *rest = features
        return df.withColumn(out, self._offset(tuple(rest)) + _as_column(self.price) * price)

    def score_grid(self, df: DataFrame, grid: str, steps: int,
                   rest: tuple[Column, Column, Column]) -> tuple[DataFrame, GridDemand]:
        """Everything but the price is the same along the grid and is added up once."""
        rows = df.withColumn("_offset", self._offset(rest))
        return rows, lambda price, index: F.col("_offset") + _as_column(self.price) * price


class MLlibDemand:
    """A fitted Spark ML regression model, alone or behind the assembler it was saved with. Rows
    whose features are missing score NULL."""

    def __init__(self, model) -> None:
        if isinstance(model, PipelineModel):
            assembler, model = model.stages
            if assembler.getInputCols() != fv.MODEL_FEATURES:
                raise ValueError(f"prices need a model of {fv.MODEL_FEATURES}, "
                                 f"not of {assembler.getInputCols()}")
        self.model = model

    def score(self, df: DataFrame, out: str, features: Features) -> DataFrame:
        kept = df.columns
        names = [f"{out}_f{i}" for i in range(len(features))]
        rows = df.withColumns({n: c.cast("double") for n, c in zip(names, features)})
        rows = VectorAssembler(inputCols=names, outputCol=f"{out}_vector",
                               handleInvalid="keep").transform(rows)
        scorer = self.model.copy()
        scorer.setFeaturesCol(f"{out}_vector").setPredictionCol(f"{out}_raw")
        complete = F.lit(True)
        for n in names:
            complete = complete & F.col(n).isNotNull()
        scored = scorer.transform(rows)
        return scored.select(*kept, F.when(complete, F.col(f"{out}_raw")).alias(out))

    def score_grid(self, df: DataFrame, grid: str, steps: int,
                   rest: tuple[Column, Column, Column]) -> tuple[DataFrame, GridDemand]:
        names = [f"_demand_{i}" for i in range(steps)]
        for i, name in enumerate(names):
            df = self.score(df, name, (F.col(grid)[i], *rest))
        gathered = df.withColumn("_demands", F.array(*names)).drop(*names)
        return gathered, lambda price, index: F.col("_demands")[index]


class PandasDemand:
    """A foreign Python model with a vectorised predict over the four features (Arrow batches)."""

    def __init__(self, predict: Callable[[pd.DataFrame], "pd.Series"]) -> None:
        def frame(price, competitor, inventory, gap) -> pd.DataFrame:
            return pd.DataFrame({"price": price, "competitor_price": competitor,
                                 "inventory_level": inventory, "price_diff_pct": gap})

        @F.pandas_udf("double")
        def one(price: pd.Series, competitor: pd.Series, inventory: pd.Series,
                gap: pd.Series) -> pd.Series:
            values = predict(frame(price, competitor, inventory, gap))
            return pd.Series(np.asarray(values, dtype="float64"))

        @F.pandas_udf("array<double>")
        def many(grid: pd.Series, competitor: pd.Series, inventory: pd.Series,
                 gap: pd.Series) -> pd.Series:
            sizes = grid.map(len).to_numpy()
            flat = np.concatenate(grid.to_numpy()) if len(grid) else np.empty(0)
            values = predict(frame(flat, *(c.to_numpy().repeat(sizes)
                                           for c in (competitor, inventory, gap))))
            cuts = np.cumsum(sizes)[:-1]
            return pd.Series(np.split(np.asarray(values, dtype="float64"), cuts))

        self._one, self._many = one, many

    def score(self, df: DataFrame, out: str, features: Features) -> DataFrame:
        return df.withColumn(out, self._one(*features))

    def score_grid(self, df: DataFrame, grid: str, steps: int,
                   rest: tuple[Column, Column, Column]) -> tuple[DataFrame, GridDemand]:
        scored = df.withColumn("_demands", self._many(F.col(grid), *rest))
        return scored, lambda price, index: F.col("_demands")[index]


def model_features(price: Column | None = None, inventory: str = "total_inventory") -> Features:
    """Model inputs of a pricing row with the usual fills: competitor price falls back to the
    scored price, stock and gap to zero."""
    at = F.col("current_price") if price is None else price
    return (at, F.coalesce(F.nanvl("competitor_price", F.lit(None).cast("double")), at),
            F.coalesce(F.col(inventory), F.lit(0.0)),
            F.coalesce(F.nanvl("price_diff_pct", F.lit(None).cast("double")), F.lit(0.0)))


def predict_demand(df: DataFrame, model, out: str = "predicted_demand") -> DataFrame:
    """Demand at the current price, never below zero."""
    scored = model.score(df, out, model_features())
    return scored.withColumn(out, F.greatest(F.nanvl(out, F.lit(None).cast("double")), F.lit(0.0)))
