"""Context bundles: a target, its callees, capped callers with snippets, and what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import first_lines, is_test_file, read_snippet, read_span
from graphloom.operators.queries import callers

#: Lines of a test caller's body; lines around another call site.
TEST_LINES, RADIUS, CALLERS = 60, 3, 20


def ranked_callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callers of every name, tests first, then by file, line and order: place from 1."""
    order = Window.partitionBy("callee_name").orderBy(F.col("is_test").desc(), "file", "line", "seq")
    return (
        callers(edges, symbols).withColumn("is_test", is_test_file(F.col("file")))
        .withColumn("place", F.row_number().over(order).cast("bigint"))
        .select(F.col("callee_name").alias("name"), "place", "caller", F.col("kind").alias("resolution"), "is_test", "file", "line", "seq", "caller_id")
    )


def with_snippets(ranked: DataFrame, symbols: DataFrame, files: DataFrame, radius: int = RADIUS) -> DataFrame:
    """ranked with snippet: a test caller's whole body up to TEST_LINES, else the lines around the call.

    The body is that of the first caller with a definition among the call sites of one line.
    """
    spans = symbols.select(F.col("id").alias("caller_id"), "start_line", "end_line")
    text = files.select(F.col("path").alias("file"), "content")
    at = Window.partitionBy("name", "file", "line").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = ranked.join(spans, "caller_id", "left").withColumn("span", F.first(F.when(F.col("start_line").isNotNull(), F.struct("start_line", "end_line")), ignorenulls=True).over(at))
    body = first_lines(read_span(F.col("content"), F.col("span.start_line"), F.col("span.end_line")), TEST_LINES)
    around = read_snippet(F.col("content"), F.col("line"), radius)
    snippet = F.when(F.col("is_test") & F.col("span").isNotNull() & (body != ""), body).otherwise(around)
    return known.join(text, "file", "left").withColumn("snippet", snippet).drop("content", "span", "start_line", "end_line")


def caller_report(edges: DataFrame, cap: int = CALLERS) -> DataFrame:
    """(name, caller_count, callers_included, test_caller_count, omitted) of callers as ranked_callers() places them: nothing is left out silently.

    Places follow from file and line, so the lines that a file has of a name travel as one array.
    """
    lines = edges.groupBy(F.col("callee_name").alias("name"), "file").agg(F.sort_array(F.collect_list(F.struct("line"))).alias("lines"))
    is_test = is_test_file(F.col("file"))
    by_name = lines.groupBy("name").agg(
        F.sum(F.size("lines")).alias("caller_count"), F.sum(F.when(is_test, F.size("lines")).otherwise(0)).alias("test_caller_count"),
        F.sort_array(F.collect_list(F.struct((~is_test).alias("later"), "file", "lines"))).alias("files"),
    )
    sites = F.flatten(F.transform("files", lambda f: F.transform(f["lines"], lambda at: F.concat_ws(":", f["file"], at["line"].cast("string")))))
    left_out = F.slice(sites, cap + 1, F.greatest(F.col("caller_count") - cap, F.lit(0)).cast("int"))
    return by_name.select(
        "name", "caller_count", F.least("caller_count", F.lit(cap)).cast("bigint").alias("callers_included"), "test_caller_count", F.array_join(left_out, ",").alias("omitted")
    )
