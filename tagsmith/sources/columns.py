"""Header clean-up. These look only at the schema; no data is read."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.functions.fixed_values import SKU_ID_ALIASES, UNSAFE_NAME_PATTERN

log = logging.getLogger(__name__)


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df if names == df.columns else df.toDF(*names)


def normalize_headers(df: DataFrame, strip: bool = True) -> DataFrame:
    """Lower-case (and strip) every column name."""
    return rename_all(df, [(c.strip() if strip else c).lower() for c in df.columns])


def keep_first_of_same_name(df: DataFrame) -> DataFrame:
    """Drop later columns that repeat an earlier name."""
    if len(set(df.columns)) == len(df.columns):
        return df
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    first = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    ordered = sorted(first.items(), key=lambda kv: kv[1])
    return numbered.select(*[F.col(f"c{i}").alias(name) for name, i in ordered])


def first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def resolve_sku_id(df: DataFrame, source: str = "table") -> DataFrame:
    """Rename the first known id alias to `sku_id`; warn when there is none."""
    if "sku_id" in df.columns:
        return df
    alias = first_present(df, SKU_ID_ALIASES)
    if alias is None:
        log.warning("%s: no sku_id column among %s", source, df.columns)
        return df
    return df.withColumnRenamed(alias, "sku_id")


def measure_column(df: DataFrame, aliases: list[str]) -> str | None:
    """The first alias present, else the first numeric column other than the id."""
    named = first_present(df, aliases)
    if named is not None:
        return named
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name != "sku_id"]
    return numeric[0] if numeric else None


def sanitize_names(df: DataFrame) -> DataFrame:
    """Replace characters that table formats reject; two names may not become one."""
    clean = [re.sub(UNSAFE_NAME_PATTERN, "_", c).strip("_") for c in df.columns]
    repeated = sorted({c for c in clean if clean.count(c) > 1})
    if repeated:
        raise ValueError(f"column names collide after clean-up: {repeated}")
    return rename_all(df, clean)
