"""Order-dependent work without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.sources.tables import materialized

#: Ranges whose totals are added up together.
BLOCK = 256


def _offsets(totals: DataFrame, values: list[str]) -> DataFrame:
    """(_part, _<value>): the total of each value over all smaller parts.

    One row per part. Parts are added up inside blocks; the few block totals are looked up.
    """
    blocks = totals.withColumn("_block", F.floor(F.col("_part") / BLOCK))
    inside = Window.partitionBy("_block").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    history = blocks.groupBy("_block").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values]).agg(
        F.collect_list(F.struct("_block", *[f"_{v}" for v in values])).alias("history")).scalar()

    def before(v: str) -> Column:
        kind = totals.schema[f"_{v}"].dataType
        earlier = F.filter("_history", lambda t: t["_block"] < F.col("_block"))
        front = F.aggregate(earlier, F.lit(0).cast(kind), lambda acc, t: acc + t[f"_{v}"])
        return F.coalesce(F.sum(f"_{v}").over(inside), F.lit(0)) + front

    return blocks.withColumn("_history", history).select(
        "_part", *[before(v).alias(f"_{v}") for v in values])


def running_total(df: DataFrame, key: str, values: list[str],
                  parts: int | None = None) -> DataFrame:
    """Adds `<value>_before`: the sum of each value over all smaller keys.

    `key` must be a number, date or timestamp and unique per row (group first), which makes a
    frequent key one row.
    Rows are cut into `parts` ranges of the key (by default one per shuffle partition) and written
    with their range number to the shared folder. A window runs inside each range, and the totals
    of the smaller ranges are joined by range number.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialized(df.repartitionByRange(parts, key).withColumn(
        "_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_{v}")
                                           for v in values])
    return ranged.join(_offsets(totals, values), "_part").select(
        *df.columns, *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_{v}"))
                       .alias(f"{v}_before") for v in values])


def _stored(c: Column, kind: T.DataType) -> Column:
    """A value in a form the driver can hold exactly, whatever the session time zone."""
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("string")


def _literal(value, kind: T.DataType) -> Column:
    return (F.timestamp_micros(F.lit(value)) if isinstance(kind, T.TimestampType)
            else F.lit(value).cast(kind))


def last_rows_cut(df: DataFrame, date_col: str, key_col: str,
                  share: int) -> tuple[Column, Column]:
    """(date, key) of the first of the last n // `share` of n rows in (date, key) order, as literals.

    Two small reads: the boundary date from per-date counts, then the boundary key among the
    rows of that date. `key_col` must be unique within a date; dates and keys are numbers, dates
    or timestamps. The driver gets one row each time.
    """
    date_type, key_type = df.schema[date_col].dataType, df.schema[key_col].dataType
    by_date = materialized(
        df.groupBy(F.col(date_col).alias("at")).agg(F.count(F.lit(1)).alias("n")), "dates")
    counts = by_date.agg(F.sum("n").alias("rows"), F.count_if(F.col("at").isNull()).alias("open"))
    rows, without_date = counts.first()
    if without_date:
        raise ValueError(f"{date_col} is missing in some rows; they have no place in time")
    size = (rows or 0) // share
    if size == 0:
        raise ValueError("too few rows for this number of splits")
    start = rows - size  # rows in front of the cut
    counted = running_total(by_date, "at", ["n"])
    edge = counted.filter((F.col("n_before") <= start)
                          & (start < F.col("n_before") + F.col("n"))).select(
        _stored(F.col("at"), date_type).alias("at"), "n_before").first()
    date = _literal(edge["at"], date_type)
    ties = df.filter(F.col(date_col) == date).select(
        F.col(key_col).alias("key"), F.lit(1).cast("bigint").alias("n"))
    first_late = running_total(ties, "key", ["n"]).filter(
        F.col("n_before") == start - edge["n_before"])
    key = first_late.select(_stored(F.col("key"), key_type)).first()[0]
    return date, _literal(key, key_type)
