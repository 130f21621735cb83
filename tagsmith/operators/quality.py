"""Checks and repairs that run before pricing or training."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.functions.numeric import finite_or_zero, real
from tagsmith.functions.text import strip

log = logging.getLogger(__name__)


class MissingColumnsError(ValueError):
    """An expected column is absent."""


def require_columns(df: DataFrame, expected: list[str], raise_on_error: bool = True) -> bool:
    """Name check against the schema; no job is started."""
    missing = [c for c in expected if c not in df.columns]
    if missing and raise_on_error:
        raise MissingColumnsError(f"missing columns: {missing}")
    if missing:
        log.warning("missing columns: %s", missing)
    return not missing


def is_absent(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: its null count and the row count, from a single pass."""
    counts = df.agg(F.count(F.lit(1)).alias("row_count"),
                    *[F.count_if(is_absent(df, c)).alias(c) for c in columns])
    return counts.unpivot("row_count", list(columns), "column_name", "null_count").select(
        "column_name", "null_count", "row_count")


def impute_golden(df: DataFrame) -> DataFrame:
    """Missing competitor price takes our price; missing gap and stock take zero."""
    return df.withColumns({
        "competitor_price": F.coalesce(real(F.col("competitor_price")), F.col("price")),
        "price_diff_pct": F.coalesce(real(F.col("price_diff_pct")), F.lit(0.0)),
        "inventory_level": F.coalesce(real(F.col("inventory_level")), F.lit(0.0)),
    })


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows with a value in every listed column (NaN counts as missing)."""
    return df.dropna(subset=columns)


def clean_golden(df: DataFrame, columns: list[str], project: bool = True) -> DataFrame:
    """Check, optionally project, impute, and drop incomplete rows."""
    require_columns(df, columns)
    kept = df.select(*columns) if project else df
    return drop_incomplete(impute_golden(kept), columns)


def _sanitized(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_zero(c).cast(kind)
    if isinstance(kind, T.StructType):
        fields = [_sanitized(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _sanitized(v, kind.valueType))
    return c


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def sanitize_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities to 0.0 in every floating field, nested ones included."""
    return df.select(*[
        _sanitized(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
        if _has_floats(f.dataType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def clean_request_ids(requests: DataFrame, id_col: str = "sku_id",
                      pos_col: str = "pos") -> DataFrame:
    """Trim ids, drop blank ones, keep the first position of each."""
    trimmed = requests.select(strip(F.col(id_col)).alias("sku_id"), F.col(pos_col).alias("pos"))
    return trimmed.filter(F.col("sku_id") != "").groupBy("sku_id").agg(F.min("pos").alias("pos"))
