"""Demand-model training and search on Spark ML."""

from __future__ import annotations

import dataclasses
import math
import random
import uuid
from multiprocessing.pool import ThreadPool
from typing import Callable

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators import sequential
from tagsmith.operators.boosting import BoostedModel, BoostingParams, bin_rows, fit_binned, fit_boosted
from tagsmith.sources.tables import remove, shared_folder
from tagsmith.operators.tree_demand import from_boosted, from_mllib

SEED = 42


_PARAMETERS = {
    "linear": set(), "xgboost": {"n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree"},
    "rf": {"n_estimators", "max_depth", "min_samples_leaf", "min_samples_split", "max_features"}}


def make_estimator(name: str, params: dict | None = None) -> Estimator:
    """`linear`, `rf` or `xgboost` (boosted trees, grown level by level) of Spark ML; others are an error.

    Parameter names are the usual ones (n_estimators, max_depth, learning_rate, ...). Leaf-wise trees,
    `lightgbm`, have no estimator: `fit_model` grows them.
    """
    p = params or {}
    if unknown := sorted(set(p) - _PARAMETERS.get(name, set(p))):
        raise ValueError(f"unsupported parameters of {name}: {unknown}")
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "linear":
        return LinearRegression(**common)
    if name == "rf":
        # A split size has no counterpart here; half of it bounds the leaves it can leave.
        leaf = max(p.get("min_samples_leaf", 1), math.ceil(p.get("min_samples_split", 2) / 2))
        return RandomForestRegressor(
            numTrees=p.get("n_estimators", 200), maxDepth=p.get("max_depth", 6),
            minInstancesPerNode=leaf, featureSubsetStrategy=p.get("max_features", "auto"),
            # else every pass walks each row down all its trees from the root
            cacheNodeIds=p.get("max_depth", 6) > 6, seed=SEED, **common)
    if name == "xgboost":
        return GBTRegressor(
            maxIter=p.get("n_estimators", 300), stepSize=p.get("learning_rate", 0.05),
            maxDepth=p.get("max_depth", 5), subsamplingRate=p.get("subsample", 0.8),
            featureSubsetStrategy=str(p.get("colsample_bytree", 0.8)), seed=SEED, **common)
    raise ValueError(f"unsupported model: {name}")


def training_frame(df: DataFrame, features: list[str] | None = None, target: str = "demand_qty",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """(label, features, kept columns) with rows of incomplete features left out."""
    names = features or fv.MODEL_FEATURES
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip")
    rows = df.select(*keep, F.col(target).cast("double").alias("label"),
                     *[F.col(c).cast("double").alias(c) for c in names])
    return assembler.transform(rows).select(*keep, "label", "features")


def boosting_params(params: dict | None = None) -> BoostingParams:
    """Parameters of leaf-wise trees by their usual names; unknown ones are an error."""
    known = {f.name for f in dataclasses.fields(BoostingParams)}
    if unknown := sorted(set(params or {}) - known):
        raise ValueError(f"unsupported parameters of lightgbm: {unknown}")
    return BoostingParams(**(params or {}))


def _as_columns(train: DataFrame, names: list[str]) -> DataFrame:
    values = vector_to_array("features")
    return train.select("label", *[values[i].alias(c) for i, c in enumerate(names)])


def fit_model(train: DataFrame, estimator: Estimator | str, params: dict | None = None,
              features: list[str] | None = None):
    """Fit any estimator, or a model by name, on a training frame."""
    if estimator == "lightgbm":
        names = list(features or fv.MODEL_FEATURES)
        return fit_boosted(_as_columns(train, names), names, "label", boosting_params(params))
    chosen = make_estimator(estimator, params) if isinstance(estimator, str) else estimator
    if estimator == "xgboost" and (n := train.count()) > SINGLE_ROWS:
        return _fit_on_points(train, chosen, n)
    return chosen.fit(train)


# --- trees over many rows ------------------------------------------------------------------------
#: Up to so many rows, boosted trees and searched forests are fitted to the rows themselves; beyond, a point stands for
#: no more than this share of all rows, or than one of PIECES shares of its cell.
SINGLE_ROWS, PIECES = 200_000, 1024


def split_points(train: DataFrame, bins: int) -> list[list[float]]:
    """Ascending limits of each feature, fewer than `bins`: between all its values where these are few, else
    its quantiles."""
    x = vector_to_array("features")
    first = train.select(F.size(x).alias("n")).first()
    rows = train.select(*[x[i].alias(f"x{i}") for i in range(first["n"])])
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in rows.columns]).first()
    limits = []
    for c in rows.columns:
        few = sorted(r[0] for r in rows.select(c).distinct().limit(bins + 1).collect())
        limits.append(sorted(set(found[c])) if len(few) > bins else
                      [a if math.isinf(a + b) else (a + b) / 2 for a, b in zip(few, few[1:])])
    return limits


def like_rows(train: DataFrame, limits: list[list[float]], rows_a_point: int) -> DataFrame:
    """(label, weight, features): points that stand for rows between the same limits in all features, with their
    number and the mean of their labels. Features are numbers of limits passed.

    The rows of a cell are dealt by hash to points of about `rows_a_point`, so a round's subsample leaves out
    small parts of a full cell and not the whole.
    """
    x, cell = vector_to_array("features"), [f"b{i}" for i in range(len(limits))]
    passed = [sum(((x[i] > v).cast("int") for v in own), F.lit(0)).alias(c) for i, (c, own) in enumerate(zip(cell, limits))]
    sums = lambda n: [F.sum(n).alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total")]
    rows = train.select(
        *passed, F.pmod(F.xxhash64("label", x), F.lit(PIECES)).alias("piece"), F.lit(1).alias("n"),
        F.col("label").isNotNull().cast("int").alias("known"), F.col("label").alias("total"))
    pieces = rows.groupBy(*cell, "piece").agg(*sums("n"))
    points = F.ceil(F.sum("n").over(Window.partitionBy(*cell)) / rows_a_point)
    pieces = pieces.withColumn("piece", F.pmod("piece", points)).groupBy(*cell, "piece").agg(*sums("n"))
    label = F.when(F.col("known") == F.col("n"), F.col("total") / F.col("n"))  # a null label is the fit's error
    return pieces.select(label.alias("label"), F.col("n").cast("double").alias("weight"),
                         array_to_vector(F.array(*[F.col(c).cast("double") for c in cell])).alias("features"))


def keep_points(train: DataFrame, bins: int, n: int) -> tuple[str, list[list[float]]]:
    """Folder of the points of `n` training rows, and the limits between them."""
    limits = split_points(train, bins)
    path = f"{shared_folder(train.sparkSession)}/points_{uuid.uuid4().hex}"
    like_rows(train, limits, math.ceil(n / SINGLE_ROWS)).write.parquet(path)
    return path, limits


def for_points(estimator: Estimator, n: int) -> Estimator:
    """The estimator for points of `n` rows: what a leaf must hold is counted in rows, as a share of all weights."""
    own = {estimator.weightCol: "weight"}
    if (least := estimator.getMinInstancesPerNode()) > 1:
        own |= {estimator.minInstancesPerNode: 1, estimator.minWeightFractionPerNode: (least - 0.5) / n}
    return estimator.copy(own)


def _fit_on_points(train: DataFrame, estimator: GBTRegressor | RandomForestRegressor, n: int):
    """Trees of rows that are alike to them: every pass sees a row by the bins of its features only, and
    a split's gain follows from numbers and sums of labels. So a pass' work grows with the cells between the
    limits, not with the rows. The trees' limits are put back into the features' own numbers."""
    spark = train.sparkSession
    path, limits = keep_points(train, estimator.getMaxBins(), n)
    points = spark.read.parquet(path).repartition(spark.sparkContext.defaultParallelism)
    model = for_points(estimator, n).fit(points)
    remove(spark, path)

    path = f"{shared_folder(spark)}/trees_{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    own = F.array(*[F.array(*map(F.lit, v)).cast("array<double>") for v in limits])
    feature, limit = F.col("nodeData.split.featureIndex"), "split.leftCategoriesOrThreshold"
    raw = F.transform(F.col(f"nodeData.{limit}"), lambda t: own[feature][F.floor(t).cast("int")])
    nodes.withColumn("nodeData", F.col("nodeData").withField(limit, raw)).write.parquet(f"{path}_own/data")
    spark.read.parquet(f"{path}/treesMetadata").write.parquet(f"{path}_own/treesMetadata")
    spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{path}_own/metadata")
    model = type(model).load(f"{path}_own")
    for folder in (path, f"{path}_own"):
        remove(spark, folder)
    return model


def predictions(model, frame: DataFrame) -> DataFrame:
    """The training or test frame with a column `prediction`, by any model of `fit_model`."""
    if not isinstance(model, BoostedModel):
        return model.transform(frame)
    values = vector_to_array("features")
    return from_boosted(model).score(frame, "prediction", tuple(values[i] for i in range(len(model.features))))


def feature_importances(model, features: list[str] | None = None):
    """[(feature, importance)] of a tree model; empty for models without importances. Of leaf-wise trees
    it is the gain of a feature's splits, as a share."""
    if isinstance(model, BoostedModel):
        gains = model.gains()
        return [(c, gains[c] / sum(gains.values()) if sum(gains.values()) else 0.0) for c in model.features]
    values = getattr(model, "featureImportances", None)
    if values is None:
        return []
    return list(zip(features or fv.MODEL_FEATURES, [float(v) for v in values.toArray()]))


# --- search ----------------------------------------------------------------------------------
def sample_boosted(rng: random.Random) -> dict:
    return {
        "n_estimators": rng.choice([200, 300, 400]),
        "max_depth": rng.choice([3, 5, 7]),
        "learning_rate": math.exp(rng.uniform(math.log(0.01), math.log(0.1))),
        "subsample": rng.uniform(0.7, 1.0),
        "colsample_bytree": rng.uniform(0.7, 1.0),
    }


def sample_leafwise(rng: random.Random) -> dict:
    return {
        "n_estimators": rng.choice([200, 300, 400]),
        "learning_rate": rng.choice([0.01, 0.05, 0.1]),
        "num_leaves": rng.choice([31, 63, 127]),
    }


def sample_forest(rng: random.Random) -> dict:
    return {
        "n_estimators": rng.choice([100, 200, 300, 400]),
        "max_depth": rng.choice([4, 6, 8, 10]),
        "min_samples_split": rng.choice([2, 5, 10]),
        "min_samples_leaf": rng.choice([1, 2, 4]),
        "max_features": rng.choice(["sqrt", "log2"]),
    }


def _set_params(estimator: Estimator) -> dict[Param, object]:
    return {param: estimator.getOrDefault(param) for param in estimator.params
            if estimator.isSet(param)}


def with_folds(train: DataFrame, key: str, folds: int) -> DataFrame:
    """Fold number by hash of the key: the same on every run, and after a lost executor."""
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    return train.withColumn("fold", (F.conv(digits, 16, 10).cast("bigint") % folds).cast("int"))


_ERRORS = "errors array<double>, n bigint"


def _mean_errors(parts: DataFrame, stages: int) -> list[float]:
    """Means of the errors that tasks have added up."""
    found = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("errors")[i]).alias(f"e{i}") for i in range(stages)]).first()
    if not found["n"]:
        raise ValueError("a fold has no rows")
    return [found[f"e{i}"] / found["n"] for i in range(stages)]


def staged_errors(model: BoostedModel, frame: DataFrame, rounds: list[int]) -> list[float]:
    """Mean absolute error of the first 1, 2, ... of `rounds` trees on a frame, from one pass: a model of
    fewer rounds is the beginning of a longer one."""
    own = from_boosted(model)
    roots, feature, next_ = (np.array(a, np.int32) for a in (own.roots, own.feature, own.next))
    limit, value = np.array(own.limit), np.array(own.value)
    depth, base, divisor = own.depth, own.base, own.divisor
    rounds = [min(k, len(roots)) for k in rounds]

    def errors(batches):
        total, n = np.zeros(len(rounds)), 0
        for batch in batches:
            label, x = batch["label"].to_numpy(), np.stack(batch["x"].to_numpy())
            row, sums = np.arange(len(x)), np.full(len(x), base)
            for k in range(max(rounds) + 1):
                if k:
                    at = np.full(len(x), roots[k - 1])
                    for _ in range(depth):
                        at = next_[at] + ~(x[row, feature[at]] <= limit[at])
                    sums += value[at]
                for i, stage in enumerate(rounds):
                    if k == stage:
                        total[i] += np.abs(label - sums / divisor).sum()
            n += len(x)
        yield pd.DataFrame({"errors": [total.tolist()], "n": [n]})

    judged = frame.where("label IS NOT NULL").select("label", vector_to_array("features").alias("x"))
    return _mean_errors(judged.mapInPandas(errors, _ERRORS), len(rounds))


def search_boosted(train: DataFrame, candidates: list[dict], key: str, folds: int = 3,
                   features: list[str] | None = None, refit: bool = True, parallelism: int = 4):
    """Cross-validated search of leaf-wise trees by mean absolute error.

    Candidates that differ in `n_estimators` only share one fit of the largest, whose beginnings are
    scored together. All fits to a fold share its binned rows, and `parallelism` of them run at once. Returns the model refitted on all rows, its parameters, and [(params, mae)].
    """
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        rest = {k: v for k, v in c.items() if k != "n_estimators"}
        groups.setdefault(tuple(sorted(rest.items())), []).append(i)
    spark, names = train.sparkSession, list(features or fv.MODEL_FEATURES)
    rows = with_folds(train, key, folds)
    sizes = sorted({boosting_params(c).max_bin for c in candidates})
    parts = [(fold, size) for fold in range(folds) for size in sizes]
    jobs = [(members, fold) for members in groups.values() for fold in range(folds)]

    def binned(part):
        own = rows.where(F.col("fold") != part[0])
        return bin_rows(_as_columns(own, names), names, "label", part[1])

    def run(job):
        members, fold = job
        params = [boosting_params(candidates[i]) for i in members]
        stages = sorted({p.n_estimators for p in params})
        longest = dataclasses.replace(params[0], n_estimators=stages[-1])
        model = fit_binned(spark, kept[fold, longest.max_bin], longest)
        found = dict(zip(stages, staged_errors(model, rows.where(F.col("fold") == fold), stages)))
        return [found[p.n_estimators] for p in params]

    with ThreadPool(parallelism) as pool:
        kept = dict(zip(parts, pool.map(inheritable_thread_target(spark)(binned), parts, chunksize=1)))
        found = pool.map(inheritable_thread_target(spark)(run), jobs, chunksize=1)
    for own in kept.values():
        remove(spark, own.folder)
    errors = [0.0] * len(candidates)
    for (members, _), own in zip(jobs, found):
        for i, error in zip(members, own):
            errors[i] += error / folds
    best = candidates[min(range(len(candidates)), key=errors.__getitem__)]
    model = fit_model(train, "lightgbm", best, features) if refit else None
    return model, best, list(zip(candidates, errors))


def _forest_kind(params: dict, n_features: int) -> tuple:
    """What a tree's growth depends on besides its depth. A forest of one tree may look at other features."""
    forest = make_estimator("rf", params)
    subset = forest.getFeatureSubsetStrategy()
    tried = {"sqrt": math.ceil(math.sqrt(n_features)), "log2": max(1, math.ceil(math.log2(n_features)))}
    return forest.getMinInstancesPerNode(), tried.get(subset, subset), forest.getNumTrees() == 1


def shared_forests(candidates: list[dict], n_features: int) -> list[tuple[int, int, list[int]]]:
    """(trees, depth, candidates): forests that hold those of several candidates, where one fit takes no more
    levels of trees than the candidates' own."""
    sizes = [(f.getNumTrees(), f.getMaxDepth()) for f in (make_estimator("rf", c) for c in candidates)]
    groups: dict[tuple, list[tuple[int, int, list[int]]]] = {}
    for i in sorted(range(len(candidates)), key=lambda i: -sizes[i][0] * sizes[i][1]):
        own = groups.setdefault(_forest_kind(candidates[i], n_features), [])
        for k, (trees, depth, members) in enumerate(own):
            both = max(trees, sizes[i][0]), max(depth, sizes[i][1])
            if both[0] * both[1] <= trees * depth + sizes[i][0] * sizes[i][1]:
                own[k] = (*both, [*members, i])
                break
        else:
            own.append((*sizes[i], [i]))
    return [g for own in groups.values() for g in own]


def staged_forest_errors(model, frame: DataFrame, sizes: list[tuple[int, int]],
                         limits: list[list[float]] | None = None) -> list[float]:
    """Mean absolute error of the first trees of a forest, cut at a depth, for each (trees, depth), from one
    pass: a tree's upper levels are the tree that a smaller depth gives. `limits` are those of the points
    that the forest was fitted to."""
    own = from_mllib(frame.sparkSession, model)
    roots, feature, next_ = (np.array(a, np.int32) for a in (own.roots, own.feature, own.next))
    limit, value = np.array(own.limit), np.array(own.value)
    if limits:
        inner = np.isfinite(limit)
        limit[inner] = [limits[f][int(t)] for f, t in zip(feature[inner], limit[inner])]
    depths = sorted({depth for _, depth in sizes})

    def errors(batches):
        total, n = np.zeros(len(sizes)), 0
        for batch in batches:
            label, x = batch["label"].to_numpy(), np.stack(batch["x"].to_numpy())
            row, sums = np.arange(len(x)), {depth: np.zeros(len(x)) for depth in depths}
            for k, root in enumerate(roots, 1):
                at = np.full(len(x), root)
                for level in range(depths[-1] + 1):
                    if level:
                        at = next_[at] + (x[row, feature[at]] > limit[at])
                    if level in sums:
                        sums[level] += value[at]
                for i, (trees, depth) in enumerate(sizes):
                    if k == trees:
                        total[i] += np.abs(label - sums[depth] / trees).sum()
            n += len(x)
        yield pd.DataFrame({"errors": [total.tolist()], "n": [n]})

    judged = frame.select("label", vector_to_array("features").alias("x"))
    return _mean_errors(judged.mapInPandas(errors, _ERRORS), len(sizes))


def search_forest(train: DataFrame, candidates: list[dict], key: str, folds: int = 3, parallelism: int = 4,
                  refit: bool = True):
    """Cross-validated search of random forests by mean absolute error, with few fits.

    The trees of a forest are grown apart from each other and level by level, so one fit holds the forests of
    fewer or shallower trees. Beyond SINGLE_ROWS training rows forests are fitted to points of like rows, which
    all fits to a fold share; errors are those of all held-out rows. Returns the best candidate's forest, grown
    by itself on all rows, its parameters, and [(params, mae)].
    """
    spark = train.sparkSession
    rows, n_features = with_folds(train, key, folds), len(fv.MODEL_FEATURES)
    first = train.select(vector_to_array("features").alias("x")).first()
    n_features = len(first["x"]) if first else n_features
    sizes = [(f.getNumTrees(), f.getMaxDepth()) for f in (make_estimator("rf", c) for c in candidates)]
    jobs = [(fold, *g) for g in shared_forests(candidates, n_features) for fold in range(folds)]
    share = math.ceil(spark.sparkContext.defaultParallelism / parallelism)  # of the cores, for each of the fits side by side

    def pointed(fold):
        own = rows.where(F.col("fold") != fold)
        n = own.count()
        path, limits = keep_points(own, make_estimator("rf").getMaxBins(), n) if n > SINGLE_ROWS else (None, None)
        return n, path, limits

    def run(job):
        fold, trees, depth, members = job
        n, path, limits = kept[fold]
        params = candidates[members[0]] | {"n_estimators": trees, "max_depth": depth}
        if path:
            model = for_points(make_estimator("rf", params), n).fit(spark.read.parquet(path).repartition(share))
        else:
            model = fit_model(rows.where(F.col("fold") != fold), "rf", params)
        return staged_forest_errors(model, rows.where(F.col("fold") == fold), [sizes[i] for i in members], limits)

    with ThreadPool(parallelism) as pool:
        kept = pool.map(inheritable_thread_target(spark)(pointed), range(folds), chunksize=1)
        found = pool.map(inheritable_thread_target(spark)(run), jobs, chunksize=1)
    for _, path, _ in kept:
        if path:
            remove(spark, path)
    errors = [0.0] * len(candidates)
    for (_, _, _, members), own in zip(jobs, found):
        for i, error in zip(members, own):
            errors[i] += error / folds
    best = candidates[min(range(len(candidates)), key=errors.__getitem__)]
    if not refit:
        model = None
    elif (n := train.count()) > SINGLE_ROWS:
        model = _fit_on_points(train, make_estimator("rf", best), n)
    else:
        model = fit_model(train, "rf", best)
    return model, best, list(zip(candidates, errors))


def search(train: DataFrame, name: str, candidates: list[dict], key: str, folds: int = 3,
           parallelism: int = 4, refit: bool = True):
    """Cross-validated search by mean absolute error.

    Returns the model refitted on all rows (None without `refit`), its parameters, and [(params, mae)]
    of all trials.
    """
    if name == "lightgbm":
        return search_boosted(train, candidates, key, folds, refit=refit, parallelism=parallelism)
    if name == "rf":
        return search_forest(train, candidates, key, folds, parallelism, refit)
    maps = [_set_params(make_estimator(name, c)) for c in candidates]
    base = make_estimator(name)
    validator = CrossValidator(
        estimator=base, estimatorParamMaps=maps, numFolds=folds, foldCol="fold",
        evaluator=RegressionEvaluator(metricName="mae"), parallelism=parallelism, seed=SEED)
    fitted = validator.fit(with_folds(train, key, folds))
    trials = list(zip(candidates, fitted.avgMetrics))
    return fitted.bestModel, min(trials, key=lambda t: t[1])[0], trials


def random_search(train: DataFrame, name: str, key: str,
                  sampler: Callable[[random.Random], dict] | None = None, trials: int = 20,
                  folds: int = 3, seed: int = SEED, parallelism: int = 4):
    """Search over `trials` seeded draws of a sampler (any `rng -> params` function)."""
    default = {"xgboost": sample_boosted, "lightgbm": sample_leafwise, "rf": sample_forest}
    draw = sampler or default[name]
    rng = random.Random(seed)
    return search(train, name, [draw(rng) for _ in range(trials)], key, folds, parallelism)


def sequential_model_search(train: DataFrame, name: str, space: sequential.Space, key: str, trials: int = 50,
                            folds: int = 3, seed: int = SEED):
    """Search whose draws depend on the errors of the earlier ones; returns as `search` does."""
    params, done = sequential.sequential_search(
        lambda p: search(train, name, [p], key, folds, refit=False)[2][0][1], space, trials, seed)
    return fit_model(train, name, params), params, done


def grid_search(train: DataFrame, name: str, grid: dict[str, list], key: str, folds: int = 3,
                parallelism: int = 4):
    """Search over every combination of a parameter grid."""
    combinations: list[dict] = [{}]
    for param, values in grid.items():
        combinations = [{**c, param: v} for c in combinations for v in values]
    return search(train, name, combinations, key, folds, parallelism)


def as_pipeline(model, features: list[str] | None = None) -> PipelineModel:
    """Assembler plus model, ready to be saved and to score raw feature columns.

    Rows of incomplete features stay, with NaN in place of what is missing.
    """
    names = features or fv.MODEL_FEATURES
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return PipelineModel(stages=[assembler, model])


