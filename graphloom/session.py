"""What a Spark session needs for this package."""

from __future__ import annotations

import tempfile
import uuid

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package from where the driver has it.

    Enough where executors see the same folders; elsewhere the package is installed or sent with --py-files.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return spark


def saved(df: DataFrame) -> DataFrame:
    """df computed once, as a Parquet table in the folder of spark.checkpoint.dir; a local master without one gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="graphloom-"))
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a lookup table may have to be sent whole to every executor.
FEW = 100_000


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def joinable(df: DataFrame) -> DataFrame:
    """df computed once, and broadcast where that shows it to be small: the other side of a join isn't shuffled then."""
    kept = saved(df)
    return F.broadcast(kept) if few(kept) else kept
