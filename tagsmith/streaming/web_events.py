"""Web-event counts kept up to date from a stream.

The running totals are the stream's own state, so no total is ever added up from history again: every
micro-batch gives absolute numbers, and a batch that is run again after a failure writes the same ones.
With many SKUs or windows set `spark.sql.streaming.stateStore.providerClass` to Spark's RocksDB provider,
which keeps the state on the executors' disks instead of in their memory.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tagsmith.operators.features import event_counts, event_items
from tagsmith.sources.tables import materialized, remove


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_event_counts(events: DataFrame, folder: str, checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Keep the counts per SKU; every micro-batch writes the totals as its own folder.

    The folder of the batch before stays for whoever is reading it, older ones go, so a reader opens one
    folder however long the stream has run.
    """
    def write(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        remove(totals.sparkSession, f"{folder}/batch={batch_id - 2}")

    writer = event_counts(events).writeStream.outputMode("complete").foreachBatch(write)
    return _started(writer, checkpoint, available_now)


def total_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per SKU after the newest micro-batch, in the form the demand score reads."""
    totals = spark.read.parquet(folder)
    newest = totals.agg(F.max("batch")).first()[0]
    return totals.where(F.col("batch") == newest).drop("batch")


def start_window_counts(events: DataFrame, time_col: str, folder: str, checkpoint: str,
                        window: str = "1 hour", lateness: str | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """Keep the counts per SKU and event-time window in a table partitioned by window.

    A micro-batch rewrites the windows that it has changed and no others. By default no event is too
    late and the state holds every window; `lateness` bounds it to the windows within that time of the
    newest event, and what comes later still is not counted.
    """
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, lateness) if lateness else timed
    counts = event_items(timed, keep=[time_col]).groupBy(F.window(time_col, window), "sku_id").agg(
        F.count_if(F.col("event_name") == "view_item").alias("views"),
        F.count_if(F.col("event_name") == "add_to_cart").alias("add_to_cart"),
    ).select(F.col("window.start").alias("window_start"), "sku_id", "views", "add_to_cart")

    def write(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed = materialized(changed, "changed_windows")
        rows = changed
        try:
            table = spark.read.schema(changed.schema).parquet(folder)
            kept = table.join(changed.select("window_start").distinct(), "window_start", "left_semi")
            rows = rows.unionByName(kept.join(changed, ["window_start", "sku_id"], "left_anti"))
            rows = materialized(rows, "merged_windows")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        (rows.repartition("window_start").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("window_start").parquet(folder))

    return _started(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now)


def total_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per SKU and window, each once."""
    columns = "sku_id string, views bigint, add_to_cart bigint, window_start timestamp"
    return spark.read.schema(columns).parquet(folder).select("window_start", "sku_id", "views", "add_to_cart")
