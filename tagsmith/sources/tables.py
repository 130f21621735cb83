"""Tables the jobs read and write: golden data, published features, priced output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.functions.fixed_values import GOLDEN_COLUMNS
from tagsmith.operators.quality import clean_golden, is_absent, require_columns
from tagsmith.sources.columns import sanitize_names


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


# --- golden training table ---------------------------------------------------------------
def read_golden(spark: SparkSession, path: str, columns: list[str] | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Projected, checked, imputed golden table. `fmt="delta"` works where the jar is present."""
    return clean_golden(spark.read.format(fmt).load(path), columns or GOLDEN_COLUMNS)


def read_golden_csv(spark: SparkSession, path: str,
                    columns: list[str] | None = None) -> DataFrame:
    """CSV fallback; columns beyond the expected ones survive."""
    expected = columns or GOLDEN_COLUMNS
    raw = spark.read.csv(path, header=True)
    numbers = [c for c in expected if c != "sku_id" and c in raw.columns]
    typed = raw.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return clean_golden(typed, expected, project=False)


def load_golden(spark: SparkSession, path: str | None, csv_fallback: str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """The primary table where it exists, else the CSV, else an error."""
    if path:
        try:
            return read_golden(spark, path, columns)
        except AnalysisException as error:
            if not _absent(error) or not csv_fallback:
                raise
    if csv_fallback:
        return read_golden_csv(spark, csv_fallback, columns)
    raise ValueError("no golden table: give a table path or a CSV fallback")


# --- file to table -----------------------------------------------------------------------
def file_to_table(spark: SparkSession, source: str, target: str,
                  schema: str | T.StructType | None = None, fmt: str = "parquet") -> None:
    """Load a CSV file and write it as a table once, in parallel, with safe column names.

    Without a schema the types are inferred, which reads the file a second time.
    """
    if not source.lower().endswith(".csv"):
        raise ValueError(f"unsupported file type: {source} (supported: .csv)")
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    table = sanitize_names(reader.csv(source))
    table.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").save(target)


def write_measured(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Write the frame and return its null report (column_name, null_count, row_count), which is counted
    while the rows are written: the frame is neither computed nor read a second time."""
    require_columns(df, columns)
    seen = Observation()
    nulls = [F.count_if(is_absent(df, c)).alias(f"nulls_{i}") for i, c in enumerate(columns)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode("errorifexists").parquet(path)
    found = seen.get
    rows = [(c, found[f"nulls_{i}"], found["rows"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, null_count bigint, row_count bigint")


# --- priced output -----------------------------------------------------------------------
def output_name(mode: str, run_date: str, model_version: str, run_id: str) -> str:
    return f"{mode}_pricing_output_{run_date}_{model_version}_{run_id}.csv"


def write_priced(df: DataFrame, folder: str, mode: str) -> None:
    """Put one run into the priced table, partitioned so later reads prune by run.

    Only the partitions of this run are replaced, so a repeated run does not double its rows.
    """
    (df.withColumn("mode", F.lit(mode)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("mode", "run_id").parquet(folder))


def read_priced(spark: SparkSession, folder: str, schema: T.StructType, mode: str,
                run_id: str) -> DataFrame:
    """One run of the priced table. The schema is given: run ids are text even when they look
    like numbers, and runs of other modes may have other columns."""
    full = schema if "mode" in schema.names else T.StructType(
        [*schema.fields, T.StructField("mode", T.StringType())])
    table = spark.read.schema(full).parquet(folder)
    return table.filter((F.col("mode") == mode) & (F.col("run_id") == run_id)).select(
        *schema.names)


def write_priced_csv(df: DataFrame, folder: str, mode: str, run_date: str, model_version: str,
                     run_id: str) -> str:
    """One CSV folder per run under the usual name; maps are written as JSON text."""
    flat = df.select(*[
        F.to_json(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f.name)
        for f in df.schema.fields
    ])
    target = f"{folder.rstrip('/')}/{output_name(mode, run_date, model_version, run_id)}"
    flat.write.mode("overwrite").csv(target, header=True)
    return target


# --- published tables ----------------------------------------------------------------------
def publish_table(df: DataFrame, name: str, folder: str, key: str, buckets: int | None = None) -> None:
    """Write the frame as the table `name` in a folder of its own, bucketed by `key` for lookups.

    A version of a table is one name and one folder, both chosen by the caller; one that exists is an
    error, so readers of an older version keep it whole. Each bucket is one file, sorted by the key:
    a join on the key hashes only its other side, and a lookup of given keys reads only their buckets.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet")
       .option("path", folder).mode("errorifexists").saveAsTable(name))


def declare_table(spark: SparkSession, name: str, folder: str, key: str, buckets: int) -> DataFrame:
    """A published table in a session whose catalog doesn't know it yet."""
    columns = spark.read.parquet(folder).schema.toDDL()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session, where every task runs on this machine, may fall back to a new
    temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tagsmith-")


#: MB of different values that a Parquet file keeps once for a column of a row group.
VALUES_MB = 64


def keep_texts_once(spark: SparkSession, column: str) -> None:
    """Sets how this session writes Parquet, where the caller hasn't: a long text that many rows share stands once
    in a row group and its rows point there.

    Parquet's own limit of 1 MB for all values of a column is below a single text of many shops, and beyond it
    every row is written with its text. Row groups are measured more often, so one whose values pass the limit
    is closed soon; the column gets no statistics, which would compare all texts byte by byte.
    """
    for key, value in (("parquet.dictionary.page.size", str(VALUES_MB << 20)), ("parquet.block.size.row.check.max", "100"),
                       (f"parquet.column.statistics.enabled#{column}", "false")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back.

    For frames that many jobs pass over, such as training rows: the plan behind them runs once,
    and a lost executor costs a re-read of files instead of a re-run.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written and no plan reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
