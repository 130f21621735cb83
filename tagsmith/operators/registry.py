"""The model registry as a table of versions. Payloads live beside it as saved models."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsmith.functions import fixed_values as fv
from tagsmith.operators.features import first_per_key

REGISTRY_SCHEMA = (
    "model_name string, model_version string, environment string, model_path string, "
    "feature_columns string, created_at timestamp_ntz, is_active boolean, stage string"
)


def new_version(spark: SparkSession, model_name: str, model_version: str, environment: str,
                model_path: str, created_at: datetime, feature_columns: list[str] | None = None,
                stage: str = "None") -> DataFrame:
    columns = json.dumps(feature_columns or fv.MODEL_FEATURES)
    row = (model_name, model_version, environment, model_path, columns, created_at, True, stage)
    return spark.createDataFrame([row], REGISTRY_SCHEMA)


def register(registry: DataFrame, model_name: str, environment: str,
             new_row: DataFrame) -> DataFrame:
    """All rows of the model and environment turned inactive, the new active row appended."""
    same = (F.col("model_name") == model_name) & (F.col("environment") == environment)
    retired = registry.withColumn("is_active", F.when(same, False).otherwise(F.col("is_active")))
    return retired.unionByName(new_row)


def save_version(path: str, model_name: str, environment: str, new_row: DataFrame,
                 previous: DataFrame | None = None) -> None:
    """Write the registry with the new version to a folder of the caller's choice; one that exists is an
    error. `previous` is the registry as it was, which stays as it is."""
    rows = new_row if previous is None else register(previous, model_name, environment, new_row)
    rows.write.mode("errorifexists").parquet(path)


def resolve(registry: DataFrame, version: str | None = None) -> DataFrame:
    """The best row of every (model, environment): the asked version if active, else the latest
    active, else the latest. Filter the registry first to resolve a single model."""
    asked = F.col("is_active") & (F.col("model_version") == F.lit(version))
    rank = (F.when(asked, 1) if version else F.when(F.lit(False), 1)).when(
        F.col("is_active"), 2).otherwise(3)
    return first_per_key(registry, ["model_name", "environment"],
                         [rank, F.col("created_at").desc(), F.col("model_path").desc()])


def resolve_one(registry: DataFrame, model_name: str, environment: str = "dev",
                version: str | None = None):
    """The resolved row; an error when the model has no row in the environment."""
    rows = versions(registry, model_name, environment)
    row = resolve(rows, version).first()
    if row is None:
        raise ValueError(f"no row for model {model_name!r} in environment {environment!r}")
    return row


def versions(registry: DataFrame, model_name: str, environment: str) -> DataFrame:
    return registry.filter((F.col("model_name") == model_name)
                           & (F.col("environment") == environment))


def metadata(registry: DataFrame) -> DataFrame:
    """Registry rows without the payload reference."""
    return registry.drop("model_path")


def champion_challenger(registry: DataFrame) -> DataFrame:
    """Newest and second newest version of every (model, environment), active or not."""
    window = Window.partitionBy("model_name", "environment").orderBy(
        F.col("created_at").desc(), F.col("model_path").desc())
    ranked = registry.withColumn("_rank", F.row_number().over(window)).filter("_rank <= 2")
    return ranked.withColumn("role", F.when(F.col("_rank") == 1, "champion")
                             .otherwise("challenger")).drop("_rank")


def _version_numbers(c: Column) -> Column:
    """All number parts of a version, so that v1.10 is above v1.9."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1),
                       lambda part: part.try_cast("decimal(38,0)"))


def _newest_first(registry: DataFrame) -> Column:
    return F.struct(_version_numbers(registry["model_version"]).alias("numbers"),
                    registry["created_at"], registry["model_path"])


def latest_versions(registry: DataFrame) -> DataFrame:
    """The highest version by its numbers (not by text) of every model, the newest of equal ones."""
    return registry.groupBy("model_name").agg(F.max(_newest_first(registry)).alias("latest_version"))


def transition(registry: DataFrame, model_name: str, version: str, stage: str) -> DataFrame:
    """Move a version to a stage; a new Production version archives the other ones.

    A version that the model doesn't have changes nothing.
    """
    mine = F.col("model_name") == model_name
    chosen = mine & (F.col("model_version") == version)
    known = F.max(chosen).over(Window.partitionBy("model_name"))
    replaced = (mine & ~chosen & (F.col("stage") == "Production") & F.lit(stage == "Production")
                & known)
    return registry.withColumn(
        "stage", F.when(chosen, stage).when(replaced, "Archived").otherwise(F.col("stage")))


def promote_latest(registry: DataFrame) -> DataFrame:
    """The highest version of every model goes to Production, older Production ones to the
    archive. One row per model is joined back, not the versions themselves."""
    keyed = registry.withColumn("own_version", _newest_first(registry))
    rows = keyed.join(latest_versions(registry), "model_name", "left")
    newest = F.col("own_version").eqNullSafe(F.col("latest_version"))
    return rows.withColumn(
        "stage", F.when(newest, "Production")
        .when(F.col("stage") == "Production", "Archived").otherwise(F.col("stage"))
    ).drop("latest_version", "own_version")


def rollback(registry: DataFrame, model_name: str, version: str,
             must_exist: bool = False) -> DataFrame:
    """Put a version back to Production; with `must_exist`, an unknown version is an error."""
    known = (F.col("model_name") == model_name) & (F.col("model_version") == version)
    if must_exist and registry.filter(known).isEmpty():
        raise ValueError(f"model {model_name!r} has no version {version!r}")
    return transition(registry, model_name, version, "Production")


def archive(registry: DataFrame, model_name: str, version: str) -> DataFrame:
    return transition(registry, model_name, version, "Archived")
