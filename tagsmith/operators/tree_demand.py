"""Tree ensembles as demand models that stay inside the row.

The nodes of all trees are four arrays: feature, limit, next and value. A row whose feature is at most
the limit goes on at `next`, else one place behind it; a leaf goes on at itself. A score is an
`aggregate` over the roots, each walked as often as the deepest tree is deep. The arrays come as a
scalar subquery of one row, so the plan holds neither an assembler nor a user function, and a price
sweep over any number of prices needs one pass. Their size is that of the model, not of the data.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators.boosting import UNIT, BoostedModel, Tree
from tagsmith.operators.demand_models import Features, GridDemand, LinearDemand, MLlibDemand
from tagsmith.sources.tables import remove, shared_folder

_ARRAYS = "roots array<int>, feature array<int>, limit array<double>, next array<int>, value array<double>"
_HELPERS = ["_roots", "_feature", "_limit", "_next", "_value"]


@dataclass(frozen=True)
class TreeDemand:
    """Sum of the trees' values, after `base`, divided by `divisor`. Rows whose features are missing
    score NULL."""

    roots: tuple[int, ...]
    feature: tuple[int, ...]
    limit: tuple[float, ...]
    next: tuple[int, ...]
    value: tuple[float, ...]
    depth: int
    base: float = 0.0
    divisor: float = 1.0

    def _with_trees(self, df: DataFrame) -> DataFrame:
        arrays = [list(x) for x in (self.roots, self.feature, self.limit, self.next, self.value)]
        model = df.sparkSession.createDataFrame([tuple(arrays)], _ARRAYS)
        return df.withColumns({f"_{c}": model.select(c).scalar() for c in model.columns})

    def _value(self, features: list[Column]) -> Column:
        x, (feature, limit, next_, value) = F.array(*features), map(F.col, ("_feature", "_limit", "_next", "_value"))

        def end(root: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(1), F.lit(self.depth)), root,
                lambda at, _: next_[at] + (x[feature[at]] > limit[at]).cast("int")) if self.depth else root

        total = F.aggregate("_roots", F.lit(float(self.base)), lambda sum_, root: sum_ + value[end(root)])
        complete = F.lit(True)
        for f in features:
            complete = complete & f.isNotNull()
        return F.when(complete, total / self.divisor if self.divisor != 1.0 else total)

    def score(self, df: DataFrame, out: str, features: Features) -> DataFrame:
        numbers = [c.cast("double") for c in features]
        return self._with_trees(df).withColumn(out, self._value(numbers)).drop(*_HELPERS)

    def score_grid(self, df: DataFrame, grid: str, steps: int,
                   rest: tuple[Column, Column, Column]) -> tuple[DataFrame, GridDemand]:
        fixed = [c.cast("double") for c in rest]
        scored = self._with_trees(df)
        scored = scored.withColumn("_demands", F.transform(grid, lambda price: self._value([price, *fixed])))
        return scored.drop(*_HELPERS), lambda price, index: F.col("_demands")[index]


def _laid_out(trees: Iterable[dict[int, tuple | float]], **rest) -> TreeDemand:
    """Trees as {node: (feature, limit, below, above, and a value if it has one) or a leaf's value}, the root
    first. Children of a node get places next to each other."""
    roots, deepest = [], 0
    feature, limit, next_, value = [], [], [], []
    for tree in trees:
        roots.append(len(feature))
        level, depth = [next(iter(tree))], 0
        while level:
            first = len(feature) + len(level)
            below = []
            for n in level:
                what = tree[n]
                leaf = not isinstance(what, tuple)
                next_.append(len(feature) if leaf else first + len(below))
                feature.append(0 if leaf else what[0])
                limit.append(math.inf if leaf else what[1])
                value.append(what if leaf else what[4] if len(what) > 4 else 0.0)
                below += () if leaf else what[2:4]
            level, depth = below, depth + 1
        deepest = max(deepest, depth - 1)
    return TreeDemand(*map(tuple, (roots, feature, limit, next_, value)), deepest, **rest)


def from_boosted(model: BoostedModel, rounds: int | None = None) -> TreeDemand:
    """The trees of leaf-wise boosting, or the first `rounds` of them. Their values are added up as whole
    millionths, so a prediction doesn't depend on the order."""
    def table(tree: Tree) -> dict[int, tuple | float]:
        rows: dict[int, tuple | float] = {}
        for n in sorted({*tree.splits, *tree.leaves}):
            if n in tree.splits:
                split = tree.splits[n]
                below_edge = math.nextafter(model.threshold(split), -math.inf)
                rows[n] = (split.feature, below_edge, 2 * n, 2 * n + 1)
            else:
                rows[n] = float(tree.leaves[n][1])
        return rows

    return _laid_out(map(table, model.trees[:rounds]), base=float(model.base), divisor=float(UNIT))


def from_mllib(spark: SparkSession, model) -> TreeDemand:
    """A fitted decision tree, random forest or boosted ensemble of Spark ML, by its saved nodes."""
    path = f"{shared_folder(spark)}/trees_{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = isinstance(model, DecisionTreeRegressionModel)
    node = "" if single else "nodeData."
    rows = data.select(
        F.lit(0).alias("tree") if single else F.col("treeID").alias("tree"), F.col(f"{node}id").alias("id"),
        F.col(f"{node}split.featureIndex").alias("feature"),
        F.get(F.col(f"{node}split.leftCategoriesOrThreshold"), F.lit(0)).alias("limit"),
        F.col(f"{node}split.numCategories").alias("categories"), F.col(f"{node}leftChild").alias("below"),
        F.col(f"{node}rightChild").alias("above"), F.col(f"{node}prediction").alias("value"),
    ).orderBy("tree", "id").collect()
    remove(spark, path)
    weights = [1.0] if single else list(model.treeWeights)
    boosted = isinstance(model, GBTRegressionModel)
    trees: list[dict[int, tuple | float]] = [{} for _ in weights]
    for r in rows:
        if r["below"] < 0:
            trees[r["tree"]][r["id"]] = r["value"] * weights[r["tree"]] if boosted else r["value"]
        elif r["categories"] >= 0:
            raise ValueError("splits on categories aren't supported")
        else:
            trees[r["tree"]][r["id"]] = (r["feature"], r["limit"], r["below"], r["above"], r["value"])
    forest = isinstance(model, RandomForestRegressionModel)
    return _laid_out(trees, divisor=float(len(trees)) if forest else 1.0)


def demand_model(spark: SparkSession, model):
    """The demand model of a fitted regression model, alone or behind the assembler it was saved with:
    linear models as their coefficients, trees as their nodes, others as they are."""
    if isinstance(model, BoostedModel):
        if model.features != fv.MODEL_FEATURES:
            raise ValueError(f"prices need a model of {fv.MODEL_FEATURES}, not of {model.features}")
        return from_boosted(model)
    wrapped = MLlibDemand(model)
    inner = wrapped.model.stages[-1] if isinstance(wrapped.model, PipelineModel) else wrapped.model
    if isinstance(inner, LinearRegressionModel):
        return LinearDemand(float(inner.intercept), *(float(w) for w in inner.coefficients))
    if isinstance(inner, (DecisionTreeRegressionModel, RandomForestRegressionModel, GBTRegressionModel)):
        return from_mllib(spark, inner)
    return wrapped
