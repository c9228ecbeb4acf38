"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


_lock = threading.Lock()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the session names; only a local session may fall back to a temp folder."""
    with _lock:
        return _checkpoint_dir(spark)


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="siftwright-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def pin(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back.

    Ids and partition numbers in it become plain data, and later readers prune columns and rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unpin(df: DataFrame) -> None:
    """Delete the files of a pinned table that no later step reads."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, key: str | None = None, name: str = "rid") -> DataFrame:
    """Pin `df` with a row id: the given unique key, or a generated one.

    A generated id depends on row order inside a partition, so it must never be computed twice.
    Pair tests read the rows many times; written once, narrow, they are not joined or cleaned again.
    """
    return pin(df.withColumn(name, F.col(key) if key is not None else F.monotonically_increasing_id()))


def small_frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A driver-made table (one row per column, pair or hypothesis) as a local relation.

    Built from Arrow, it joins and broadcasts without a job of its own.
    """
    schema = T.StructType.fromDDL(ddl)
    values = [tuple(r) if not isinstance(r, dict) else tuple(r.get(n) for n in schema.names) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(
        [dict(zip(schema.names, (_plain(x) for x in v))) for v in values], schema=to_arrow_schema(schema)
    ), schema)


def _plain(x):
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    return x
