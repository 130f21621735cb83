"""The training job: split, tune or fit, evaluate, save, register."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tagsmith.functions import fixed_values as fv
from tagsmith.operators import registry
from tagsmith.operators.boosting import BoostedModel
from tagsmith.operators.evaluation import actual_vs_predicted, regression_metrics
from tagsmith.operators.quality import clean_golden
from tagsmith.operators.splits import random_split
from tagsmith.operators.tree_demand import demand_model
from tagsmith.operators.training import (
    as_pipeline, feature_importances, fit_model, predictions, random_search, training_frame,
)


@dataclass(frozen=True)
class TrainingSpec:
    model_name: str = "xgboost"
    model_version: str = "v1.0"
    environment: str = "dev"
    features: tuple[str, ...] = tuple(fv.MODEL_FEATURES)
    target: str = "demand_qty"
    expected: tuple[str, ...] = ()
    key: str = "sku_id"
    test_size: float = 0.2
    seed: int = 42
    params: dict = field(default_factory=dict)
    trials: int = 0  # 0 fits the given parameters without a search

    def expected_columns(self) -> list[str]:
        return list(self.expected) or [*self.features, self.target]


def train(golden: DataFrame, spec: TrainingSpec = TrainingSpec()) -> dict:
    """Model, chosen parameters, training rows, test scores, metrics and importances."""
    needed = list(dict.fromkeys([spec.key, *spec.expected_columns()]))
    rows = clean_golden(golden, needed)
    names = list(spec.features)
    train_rows, test_rows = random_split(rows, spec.key, spec.test_size, spec.seed)
    frame = training_frame(train_rows, names, spec.target, keep=(spec.key,))
    params = dict(spec.params)
    if spec.trials and spec.model_name != "linear":
        model, params, _ = random_search(frame, spec.model_name, spec.key, trials=spec.trials,
                                         seed=spec.seed)
    else:
        model = fit_model(frame, spec.model_name, params, names)
    test = training_frame(test_rows, names, spec.target, keep=(spec.key,))
    scored = actual_vs_predicted(predictions(model, test), spec.key, "label")
    return {"model": model, "params": params, "rows": frame, "scored": scored,
            "metrics": regression_metrics(scored),
            "importances": feature_importances(model, names)}


def train_and_register(golden: DataFrame, spec: TrainingSpec, model_folder: str,
                       registry_path: str, now: datetime, previous: DataFrame | None = None) -> dict:
    """Train, save the model in the shared folder, and write the registry with it: the rows of
    `previous`, if there are any, and the new version."""
    out = train(golden, spec)
    path = f"{model_folder.rstrip('/')}/{spec.model_name}_{spec.model_version}"
    if isinstance(out["model"], BoostedModel):
        out["model"].save(path, golden.sparkSession)
    else:
        as_pipeline(out["model"], list(spec.features)).write().overwrite().save(path)
    row = registry.new_version(golden.sparkSession, spec.model_name, spec.model_version,
                               spec.environment, path, now, list(spec.features))
    registry.save_version(registry_path, spec.model_name, spec.environment, row, previous)
    return {**out, "path": path}


def load_model(spark: SparkSession, model_name: str, path: str):
    """A saved model, ready to price with."""
    saved = BoostedModel.load(path, spark) if model_name == "lightgbm" else PipelineModel.load(path)
    return demand_model(spark, saved)


def registered_model(spark: SparkSession, registry_path: str, model_name: str,
                     environment: str = "dev", version: str | None = None):
    """The model that the registry resolves to, ready to price with."""
    rows = spark.read.parquet(registry_path)
    row = registry.resolve_one(rows, model_name, environment, version)
    return load_model(spark, model_name, row["model_path"])


def champion_and_challenger(spark: SparkSession, registry_path: str, model_name: str,
                            environment: str = "dev") -> tuple:
    """The newest version and the one before it, if there is one."""
    rows = registry.versions(spark.read.parquet(registry_path), model_name, environment)
    paths = {r["role"]: r["model_path"] for r in registry.champion_challenger(rows).collect()}
    if not paths:
        raise ValueError(f"no row for model {model_name!r} in environment {environment!r}")
    models = {role: load_model(spark, model_name, p) for role, p in paths.items()}
    return models["champion"], models.get("challenger")
