"""A change feed of source files as a stream that keeps a parsed table fresh.

An extension: the graph has no stream of its own, and a refresh on demand is a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: path, version (greater is newer), content; a null content deletes the file.
FEED = "path string, version bigint, content string"


def newest(changes: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    order = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("content"))
    return changes.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def apply(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The table (path, version, content) after a batch; an older version than the stored one changes nothing."""
    both = current.unionByName(newest(changes))
    return newest(both).select(*current.columns)


def follow(spark: SparkSession, feed: str, table: str, checkpoint: str) -> StreamingQuery:
    """Fold a folder of JSON changes into the Parquet table at `table`, one snapshot a batch.

    A batch that is tried again writes the same snapshot folder, so each change counts once.
    """

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = session.read.parquet(f"{table}/batch={number - 1}") if number else session.createDataFrame([], FEED)
        apply(last, batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(FEED).json(feed)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
