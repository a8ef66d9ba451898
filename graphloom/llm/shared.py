"""Folders and written tables that every executor of the cluster can read."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where the setting is absent, a folder set on the context before is used; a local master may fall
    back to a temporary folder, any other master raises, as a machine's own folder is not shared.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(named)
    # A path without a scheme is of the cluster's default file system, as for checkpoints.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/graphloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there.

    An executor that is lost takes nothing with it that a later stage needs.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are through; it does so when their objects are collected."""
    for _ in range(2):  # Python's hold on them goes first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Raise TypeError unless ids are whole numbers, which the packed tables of some operators need."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")


def apart(names: list[str], taken: list[str]) -> list[str]:
    """names, with underscores added to those that are taken already."""
    out: list[str] = []
    for name in names:
        while name in taken or name in out:
            name += "_"
        out.append(name)
    return out


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: whatever names they have, dots and repetitions included, nothing clashes."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow by a function that keeps the columns, which it must find by position."""
    rows = plain(df)
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)


def release(spark: SparkSession) -> None:
    """Delete this application's written tables; call when no result of it is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark).rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
