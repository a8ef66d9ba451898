"""Graph questions in batch form: each takes tables and gives flat rows; one symbol is a filter on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import dotted_file, fq_name, has_source_ext, module_file, path_suffixes
from graphloom.schema import Graph
from graphloom.session import joinable

MODULE = "<module>"


def _count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def label_counts(edges: DataFrame, *by: str) -> DataFrame:
    """edges, exact, ambiguous, unresolved for each value of `by`."""
    return edges.groupBy(*by).agg(
        F.count("*").alias("edges"), *(_count_if(F.col("kind") == label).alias(label) for label in ("exact", "ambiguous", "unresolved"))
    )


def status(graph: Graph, edges: DataFrame) -> DataFrame:
    """One row: files, symbols, imports, edges by label, unparsed files."""
    counts = [
        t.agg(F.count("*").alias(n))
        for n, t in (("files", graph.files), ("symbols", graph.symbols), ("imports", graph.imports), ("unparsed", graph.parse_failures))
    ]
    row = label_counts(edges)
    for c in counts:  # one row each
        row = row.crossJoin(F.broadcast(c))
    return row


def callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every edge with the name of its caller, <module> where no definition encloses it.

    A caller is named as the call's `enclosing`, so edges that kept this column need no join.
    """
    if "enclosing" in edges.columns:
        return edges.withColumn("caller", F.when(F.col("caller_id").isNotNull(), F.col("enclosing")).otherwise(MODULE)).drop("enclosing")
    who = symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    return edges.join(who, "caller_id", "left").withColumn("caller", F.coalesce("caller_name", F.lit(MODULE))).drop("caller_name")


def enumerate_names(graph: Graph, edges: DataFrame) -> DataFrame:
    """For each defined or called name: definitions, call sites, files with call sites, call sites by label."""
    defs = graph.symbols.groupBy("name").agg(F.count("*").alias("def_count"))
    calls = edges.groupBy(F.col("callee_name").alias("name")).agg(
        F.count("*").alias("caller_count"), F.countDistinct("file").alias("caller_file_count"),
        *(_count_if(F.col("kind") == label).alias(label) for label in ("exact", "ambiguous", "unresolved")),
    )
    return defs.join(calls, "name", "full").na.fill(0)


def callees(edges: DataFrame, symbols: DataFrame, target: Column) -> DataFrame:
    """One row for each (target, callee name): the edge of the first definition and call site among the targets' ones.

    target: an expression on caller_* columns of symbols that groups definitions into targets.
    """
    # Of a definition's calls of one name and edge only the first can be it; where edges lie by file, that takes no shuffle.
    calls = edges.where("caller_id is not null").groupBy("file", "caller_id", "callee_name", "kind", "callee_id").agg(F.min("seq").alias("seq"))
    named = symbols.groupBy("file", "name").agg(F.min(F.struct("seq", "id"))["id"].alias("id"))  # callers are the first of a name in their file
    defs = joinable(
        symbols.join(named.select("id"), "id", "left_semi")
        .select(F.col("id").alias("caller_id"), target.alias("target"), F.struct(F.col("file"), F.col("start_line"), F.col("id")).alias("target_order"))
    )
    order = Window.partitionBy("target", "callee_name").orderBy("target_order", "seq")
    first = calls.join(defs, "caller_id").withColumn("place", F.row_number().over(order)).where("place = 1")
    to = symbols.select(F.col("id").alias("callee_id"), F.col("file").alias("callee_file"), F.col("start_line").alias("callee_line"), "signature", "docstring")
    return first.join(to, "callee_id", "left").select("target", "callee_name", F.col("kind").alias("resolution"), "callee_file", "callee_line", "signature", "docstring")


def definitions(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        fq_name(F.col("file"), F.col("name"), F.col("parent_class")).alias("fq_name"), "name", "kind", "file", "start_line", "end_line", "signature", "docstring", "parent_class", "id"
    )


def existing(graph: Graph, wanted: DataFrame, prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """(definitions, imports) whose name is a value of wanted.wanted, or begins with one; letter case counts."""
    if not prefix:
        defs = definitions(graph.symbols).join(wanted, F.col("name") == F.col("wanted"))
        names = graph.import_names.join(wanted, F.col("local") == F.col("wanted"))
        return defs, names.select("wanted", "file", "source_module").distinct()
    # By equality of the first letters, for each length that is wanted: no pair is compared that isn't a match.
    lengths = wanted.select(F.length("wanted").alias("long")).distinct()
    keyed = wanted.withColumn("long", F.length("wanted"))

    def begins(rows: DataFrame, name: str) -> DataFrame:
        heads = rows.join(F.broadcast(lengths), F.length(name) >= F.col("long")).withColumn("head", F.substring(name, F.lit(1), F.col("long")))  # a row a length
        return heads.join(keyed.select("wanted", F.col("wanted").alias("head"), "long"), ["head", "long"]).drop("head", "long")

    return begins(definitions(graph.symbols), "name"), begins(graph.import_names, "local").select("wanted", "file", "source_module").distinct()


def surface_files(graph: Graph, modules: DataFrame) -> DataFrame:
    """(module, file) for modules.module: the path itself if indexed, else the first path that ends with it, else what it would be."""
    wanted = modules.select("module", module_file(F.col("module")).alias("wanted_file"))
    ends = graph.files.select("path", F.explode(path_suffixes(F.col("path"))).alias("wanted_file"))
    first = ends.groupBy("wanted_file").agg(F.min(F.struct(F.col("path") != F.col("wanted_file"), "path")).alias("best"))
    return wanted.join(first, "wanted_file", "left").select("module", F.coalesce("best.path", "wanted_file").alias("file"))


def surface(graph: Graph, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(top-level definitions, methods of top-level classes in the same file, imports) of files.file."""
    inside = graph.symbols.join(files.select("file").distinct(), "file", "left_semi")
    columns = ["file", "name", "kind", "start_line", "end_line", "signature", "docstring"]
    top = inside.where("parent_class is null")
    classes = top.where("kind = 'class'").select("file", F.col("name").alias("class_name"), F.col("start_line").alias("class_line"))
    methods = inside.where("parent_class is not null").withColumnRenamed("parent_class", "class_name").join(classes, ["file", "class_name"])
    imports = graph.imports.join(files.select("file").distinct(), "file", "left_semi")
    return top.select(*columns), methods.select(*columns, "class_name", "class_line"), imports.select("file", "raw", "line")


# Target specs --------------------------------------------------------------------------------------


def lookup_file_name(symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """specs (spec, file, name) of the form path::name -> definitions."""
    ends = symbols.select("id", F.explode(path_suffixes(F.col("file"))).alias("want_file"), F.col("name").alias("want_name"))
    wanted = specs.select("spec", F.col("file").alias("want_file"), F.col("name").alias("want_name"))
    return wanted.join(ends, ["want_file", "want_name"]).select("spec", "id").distinct()


def lookup_line(symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """specs (spec, file, line) of the form path:LINE -> the innermost definition around the line."""
    ends = symbols.select("id", F.col("file").alias("def_file"), "seq", "start_line", "end_line", F.explode(path_suffixes(F.col("file"))).alias("want_file"))
    wanted = specs.select("spec", F.col("file").alias("want_file"), F.col("line").alias("want_line"))
    inside = wanted.join(ends, "want_file").where("start_line <= want_line and end_line >= want_line")
    order = Window.partitionBy("spec").orderBy(F.col("end_line") - F.col("start_line"), "def_file", "start_line", "seq")
    return inside.withColumn("place", F.row_number().over(order)).where("place = 1").select("spec", "id")


def lookup_module(symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """specs (spec) of the form module.name -> definitions outside classes in files of that module path."""
    split = specs.select("spec", F.regexp_extract("spec", r"^(.*)\.([^.]*)$", 1).alias("module"), F.regexp_extract("spec", r"^(.*)\.([^.]*)$", 2).alias("name"))
    return lookup_file_name(symbols.where("parent_class is null"), split.select("spec", dotted_file(F.col("module")).alias("file"), "name"))


def lookup_class_method(symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """specs (spec) of the form [module.]Class.method -> methods of classes of that name."""
    split = specs.select(
        "spec", F.regexp_extract("spec", r"^(?:.*\.)?([^.]*)\.([^.]*)$", 1).alias("parent_class"), F.regexp_extract("spec", r"\.([^.]*)$", 1).alias("name")
    )
    return split.join(symbols.where("parent_class is not null"), ["parent_class", "name"]).select("spec", "id")


def lookup_bare(symbols: DataFrame, specs: DataFrame) -> DataFrame:
    return specs.select("spec").join(symbols, F.col("spec") == F.col("name")).select("spec", "id")


def lookup(symbols: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, name, id): what each spec means; id is null where nothing is found.

    path::name; path.ext:LINE; module.name, and where that finds nothing, Class.method; else a bare name.
    """
    s = F.col("spec")
    kind = (
        F.when(s.contains("::"), "file_name")
        .when(s.rlike(r":[+-]?\d+$") & has_source_ext(F.regexp_extract(s, r"^(.*):[^:]*$", 1)), "line")
        .when(s.contains("."), "dotted").otherwise("bare")
    )
    typed = specs.select("spec").distinct().withColumn("form", kind)
    pair = typed.where("form = 'file_name'").select("spec", F.expr("substring(spec, 1, instr(spec, '::') - 1)").alias("file"), F.expr("substring(spec, instr(spec, '::') + 2)").alias("name"))
    line = typed.where("form = 'line'").select("spec", F.regexp_extract(s, r"^(.*):[^:]*$", 1).alias("file"), F.regexp_extract(s, r":([^:]*)$", 1).cast("bigint").alias("line"))
    dotted = typed.where("form = 'dotted'")
    module = lookup_module(symbols, dotted)
    rest = dotted.join(module, "spec", "left_anti")
    method = lookup_class_method(symbols, rest)
    bare = lookup_bare(symbols, typed.where("form = 'bare'").select("spec").union(rest.join(method, "spec", "left_anti").select("spec")))
    named = symbols.select("id", "name")
    hits = lookup_file_name(symbols, pair).union(lookup_line(symbols, line)).union(module).union(method).union(bare)
    asked = pair.select("spec", F.col("name").alias("asked"))
    return (
        typed.join(hits, "spec", "left").join(named, "id", "left").join(asked, "spec", "left")
        .select("spec", F.coalesce("asked", "name", "spec").alias("name"), "id")
    )

