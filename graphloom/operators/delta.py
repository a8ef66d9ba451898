"""Keeping a graph fresh: which files changed, and the graph after they are read again.

Rows of changed and deleted files are replaced. Edges are a function of the base tables, and a call's edge
of those rows only that its names lead to: edges of calls that a change can reach are resolved anew, all
others stay, and the result equals a full rebuild.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import dotted_file, path_suffixes
from graphloom.operators.resolve import attribute_callers, edges_of_calls, expand_aliases, indexed
from graphloom.schema import Graph
from graphloom.session import joinable


def changed_files(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change): changed, added or deleted, from path and hash of both sides."""
    old = stored.select("path", F.col("hash").alias("old_hash"))
    new = disk.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return old.join(new, "path", "full").select("path", change.alias("change")).where("change is not null")


def refreshed(stored: Graph, changes: DataFrame, parsed: Graph) -> Graph:
    """stored without rows of the changed paths, with those of parsed."""
    paths = changes.select(F.col("path").alias("gone"))

    def replace(name: str, table: DataFrame) -> DataFrame:
        key = "path" if name == "files" else "file"
        return table.join(paths, F.col(key) == F.col("gone"), "left_anti").unionByName(parsed.tables()[name].select(*table.columns))

    return stored.map(replace)


def affected_names(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """Names defined in changed files before or after."""
    paths = changes.select(F.col("path").alias("file"))
    both = before.select("file", "name").union(after.select("file", "name"))
    return both.join(paths, "file", "left_semi").select("name").distinct()


def _reach(before: Graph, after: Graph, changes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function of rows (calls or edges, with file, callee_name and receiver_class) that adds `reached`: whether the changes may alter their edges.

    That is so in a changed file; where a changed file defines, or defined, the callee's name, the receiver's
    or its base's; and where the receiver is imported from a module whose file has come or gone.
    """
    names = joinable(affected_names(before.symbols, after.symbols, changes))
    derived = [g.symbols.join(names.withColumnRenamed("name", "base_class"), "base_class", "left_semi").select("name") for g in (before, after)]
    receivers = joinable(names.union(derived[0]).union(derived[1]).distinct())
    moved = changes.where("change <> 'changed'").select(F.explode(path_suffixes(F.col("path"))).alias("moved")).distinct()
    imported = joinable(after.import_names.join(moved, dotted_file(F.col("source_module")) == F.col("moved"), "left_semi").select(F.col("file").alias("i_file"), F.col("local").alias("i_local")).distinct())
    paths = joinable(changes.select(F.col("path").alias("file")))
    yes = F.lit(True)

    def reached(rows: DataFrame) -> DataFrame:
        return (
            rows.join(paths.withColumn("by_file", yes), "file", "left")
            .join(names.select(F.col("name").alias("callee_name"), yes.alias("by_name")), "callee_name", "left")
            .join(receivers.select(F.col("name").alias("receiver_class"), yes.alias("by_receiver")), "receiver_class", "left")
            .join(imported.withColumn("by_import", yes), (F.col("file") == F.col("i_file")) & (F.col("receiver_class") == F.col("i_local")), "left")
            .withColumn("reached", F.coalesce("by_file", "by_name", "by_receiver", "by_import", F.lit(False)))
            .select(*rows.columns, "reached")
        )

    return reached


def incremental_edges(edges: DataFrame, before: Graph, after: Graph, changes: DataFrame) -> DataFrame:
    """Edges of `after`, from those of `before`: what the changes (path, change) can't reach is taken over."""
    reached, index = _reach(before, after, changes), indexed(after.symbols)
    kept = reached(edges).where("not reached").drop("reached")
    calls = attribute_callers(expand_aliases(after.call_sites, after.aliases), after.symbols, index)
    fresh = reached(calls).where("reached").drop("reached")
    return kept.unionByName(edges_of_calls(fresh, after, index=index))


def reached_calls(before: Graph, after: Graph, changes: DataFrame) -> DataFrame:
    """Call sites of unchanged files whose edges the changes may alter: all others have the same edge before and after."""
    calm = before.call_sites.join(changes.select(F.col("path").alias("file")), "file", "left_anti")
    reached = _reach(before, after, changes)(expand_aliases(calm, before.aliases))
    return reached.where("reached").select(*before.call_sites.columns)


def relabelled(before: DataFrame, after: DataFrame, symbols_before: DataFrame, symbols_after: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges of unchanged files whose label or target (file, name, start line) differs."""
    paths = changes.select(F.col("path").alias("file"))

    def targets(edges: DataFrame, symbols: DataFrame, side: str) -> DataFrame:
        to = symbols.select(F.col("id").alias("callee_id"), F.struct("file", "name", "start_line").alias("to"))
        kept = edges.join(paths, "file", "left_anti").join(to, "callee_id", "left")
        return kept.select("file", "seq", F.col("kind").alias(f"{side}_kind"), F.col("to").alias(f"{side}_to"))

    both = targets(before, symbols_before, "old").join(targets(after, symbols_after, "new"), ["file", "seq"])
    return both.where("not (old_kind <=> new_kind) or not (old_to <=> new_to)").select("file", "seq", "old_kind", "new_kind")
