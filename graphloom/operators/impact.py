"""What a change touches: changed line ranges against definitions, and callers of what they hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import fq_name
from graphloom.operators.queries import callers
from graphloom.session import joinable

#: Callers that are listed for a symbol; all are counted.
CALLERS = 20


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Definitions that overlap a range (file, range_start, range_end), once each."""
    hit = symbols.join(ranges.select("file", "range_start", "range_end").distinct(), "file").where("start_line <= range_end and end_line >= range_start")
    return symbols.join(hit.select("id").distinct(), "id", "left_semi")


def files_without_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Changed files in which no definition is hit."""
    return ranges.select("file").distinct().join(changed_symbols(symbols, ranges).select("file"), "file", "left_anti")


def impact(changed: DataFrame, status: str, edges: DataFrame) -> DataFrame:
    """For each changed definition: fq_name, file, span, kind, status, caller_count, caller_files, callers_omitted.

    Callers go by bare name, over all files and languages.
    """
    counts = edges.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("f"))
    return changed.join(counts, "name", "left").select(
        fq_name(F.col("file"), F.col("name"), F.col("parent_class")).alias("fq_name"), "name", "file", "start_line", "end_line", "kind",
        F.lit(status).alias("status"), F.coalesce("n", F.lit(0)).alias("caller_count"), F.coalesce("f", F.lit(0)).alias("caller_files"),
        F.greatest(F.coalesce("n", F.lit(0)) - CALLERS, F.lit(0)).alias("callers_omitted"),
    )


def impact_callers(changed: DataFrame, edges: DataFrame, symbols: DataFrame, most: int = CALLERS) -> DataFrame:
    """(name, place, caller, file, line, resolution): the first callers of each changed name by file, line and order."""
    names = joinable(changed.select(F.col("name").alias("callee_name")).distinct())
    order = Window.partitionBy("callee_name").orderBy("file", "line", "seq")
    placed = edges.join(names, "callee_name", "left_semi").withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most)
    return callers(placed, symbols).select(F.col("callee_name").alias("name"), "place", "caller", "file", "line", F.col("kind").alias("resolution"))
