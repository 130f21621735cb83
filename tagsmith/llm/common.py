"""Shared folder, shipping of this package, and small Arrow helpers."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where it is unset, a folder of this local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tagsmith-shared-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tagsmith-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(to := os.path.join(folder, "tagsmith_code.zip"), "w") as z:
        for part in ("__init__.py", *(f"llm/{f}" for f in sorted(os.listdir(f"{here}/llm")) if f.endswith(".py"))):
            z.write(f"{here}/{part}", f"tagsmith/{part}")
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)


def map_arrow(
    df: DataFrame, task: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str,
) -> DataFrame:
    """`mapInArrow` over column lists: the task gets and yields {column: values}."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)} for b in batches)
        for out in task(columns):
            arrays = [pa.array(out[f.name], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, schema)


def add_columns(
    df: DataFrame, inputs: list[str], make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str,
) -> DataFrame:
    """Adds the columns of `schema`, which make()(lists of the input columns) gives for each Arrow batch.

    The other columns pass through as they are, so rows need no key and nothing is shuffled. Names must be
    new to the frame; see `fresh`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    new = StructType.fromDDL(schema)
    fields = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = make()
        for b in batches:
            out = task({c: b.column(c).to_pylist() for c in inputs})
            arrays = [pa.array(out[f.name], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *fields.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: str | None) -> int:
    """64 bits of a text, as a signed number; tells rows of one id apart."""
    if text is None:
        return 0
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
