"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing underscore avoids an imported name."""
    _REGISTERED[fn.__name__.rstrip("_")] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)
