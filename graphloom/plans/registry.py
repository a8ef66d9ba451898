"""Queries over the derived corpus, one for each operator of the graph engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import bundle as B
from graphloom.operators import delta as D
from graphloom.operators import impact as I
from graphloom.operators import queries as Q
from graphloom.operators import resolve as R
from graphloom.plans import samples
from graphloom.plans.corpus import derived, table
from graphloom.schema import Graph
from graphloom.session import joinable, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _edges(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = derived(spark, sf_dir)
    return g, R.edges_of(g, "enclosing")


def _shown(rows: DataFrame, *numbers: str) -> DataFrame:
    """-1 for no number: engines differ in how they hand over null numbers."""
    return rows.na.fill(dict.fromkeys(numbers, -1))


# Resolution ---------------------------------------------------------------------------------------


@query
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)[1]
    return _shown(edges, "caller_id", "callee_id").select("file", "seq", "line", "callee_name", "call_kind", "receiver_class", "caller_id", "callee_id", "kind", "rule")


@query
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].groupBy("rule", "kind").agg(F.count("*").alias("edges"))


@query
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.label_counts(_edges(spark, sf_dir)[1])


@query
def label_by_call_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Q.label_counts(_edges(spark, sf_dir)[1], "call_kind")
    return counts.withColumn("in_repo_exact_permille", F.expr("1000 * exact div (exact + ambiguous)"))


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.status(*_edges(spark, sf_dir))


@query
def resolve_edges_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = R.edges_of(derived(spark, sf_dir, aliased=True))
    return edges.where("name <> callee_name").select("file", "seq", "name", "callee_name", "kind", "rule")


@query
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir, aliased=True)
    return R.expand_aliases(g.call_sites, g.aliases).groupBy("file", "name", "callee_name").agg(F.count("*").alias("calls"))


@query
def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_edges(spark, sf_dir)[1], "callee_id").where("rule in ('IMP', 'A_IMP')").select("file", "seq", "callee_name", "callee_id", "kind")


@query
def receiver_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_edges(spark, sf_dir)[1], "callee_id").where("rule in ('RC', 'A_RC')").select("file", "seq", "callee_name", "receiver_class", "callee_id", "kind")


@query
def base_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].where("rule = 'BASE'").select("file", "seq", "callee_name", "receiver_class", "callee_id")


@query
def external_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].where("rule = 'EXT'").groupBy("receiver_class").agg(F.count("*").alias("calls"), F.countDistinct("file").alias("files"))


@query
def same_file_last_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].where("rule = 'SAME'").select("file", "seq", "callee_name", "callee_id")


@query
def caller_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return R.attribute_callers(g.call_sites, g.symbols).groupBy("file", "enclosing", "caller_id").agg(F.count("*").alias("calls"))


@query
def edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many definitions each ambiguous edge may mean."""
    g, edges = _edges(spark, sf_dir)
    size = g.symbols.groupBy(F.col("name").alias("callee_name"), "lang").agg(F.count("*").alias("candidates"))
    return edges.where("kind = 'ambiguous'").join(size, ["callee_name", "lang"]).groupBy("callee_name", "lang", "candidates").agg(F.count("*").alias("edges"))


@query
def top_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 names of most unresolved calls, ties by name."""
    edges = _edges(spark, sf_dir)[1].where("kind = 'unresolved'")
    return edges.groupBy("callee_name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "callee_name").limit(25)


# Questions ----------------------------------------------------------------------------------------


@query
def enumerate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.enumerate_names(*_edges(spark, sf_dir))


@query
def closure_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, edges = _edges(spark, sf_dir)
    return Q.callers(edges, g.symbols).select(F.col("callee_name").alias("name"), "caller", "file", "line", "seq", F.col("kind").alias("resolution"))


@query
def closure_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, edges = _edges(spark, sf_dir)
    return Q.callees(edges, g.symbols, F.col("name")).withColumnRenamed("target", "name").transform(_shown, "callee_line")


@query
def fq_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.definitions(derived(spark, sf_dir).symbols)


def _wanted(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return derived(spark, sf_dir).symbols.where(f"id % {every} = 0").select(F.col("name").alias("wanted")).distinct()


@query
def exists_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.existing(derived(spark, sf_dir), _wanted(spark, sf_dir, 7))[0].select("wanted", "fq_name", "kind", "file", "start_line", "end_line", "signature", "docstring")


@query
def exists_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _wanted(spark, sf_dir, 7).select(F.substring("wanted", 1, 5).alias("wanted")).distinct()
    return Q.existing(derived(spark, sf_dir), heads, prefix=True)[0].groupBy("wanted").agg(F.count("*").alias("defs"), F.countDistinct("file").alias("files"))


@query
def exists_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.existing(derived(spark, sf_dir), _wanted(spark, sf_dir, 7))[1]


def _modules(g: Graph) -> DataFrame:
    """Paths, path endings and dotted names of some files, and a module that doesn't exist."""
    path = F.col("path")
    some = g.files.where("bigint(regexp_extract(path, 'm([0-9]+)', 1)) % 3 <> 1")
    forms = F.array(path, F.substring_index(path, "/", -1), F.replace(F.regexp_replace(path, r"\.(py|rs)$", ""), F.lit("/"), F.lit(".")), F.lit("no.such.module"))
    return some.select(F.explode(forms).alias("module")).distinct()


@query
def surface_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    failed = g.parse_failures.select("file", F.lit(True).alias("failed"))
    return Q.surface_files(g, _modules(g)).join(failed, "file", "left").select("module", "file", F.coalesce("failed", F.lit(False)).alias("unparsed"))


@query
def surface_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return Q.surface(g, Q.surface_files(g, _modules(g)))[0]


@query
def surface_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return Q.surface(g, Q.surface_files(g, _modules(g)))[1]


@query
def surface_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    return Q.surface(g, Q.surface_files(g, _modules(g)))[2]


def _specs(symbols: DataFrame) -> DataFrame:
    """(spec, form) of all forms, some of which find nothing."""
    dotted = F.replace(F.regexp_replace("file", r"\.(py|rs)$", ""), F.lit("/"), F.lit("."))
    base = F.substring_index("file", "/", -1)
    forms = [
        (F.col("name"), "bare"),
        (F.concat_ws("::", "file", "name"), "file_name"),
        (F.concat_ws("::", base, "name"), "file_name"),
        (F.concat_ws(":", "file", (F.col("start_line") + 2).cast("string")), "line"),
        (F.concat_ws(":", base, (F.col("start_line") + 2).cast("string")), "line"),
        (F.concat_ws(".", dotted, "name"), "module"),
        (F.concat_ws(".", F.coalesce("parent_class", F.lit("NoClass")), F.col("name")), "class_method"),
    ]
    made = symbols.where("id % 17 = 0").select(F.explode(F.array(*(F.struct(c.alias("spec"), F.lit(f).alias("form")) for c, f in forms))).alias("x"))
    return made.select("x.spec", "x.form").distinct()


def _looked_up(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    s = derived(spark, sf_dir).symbols
    return Q.lookup(s, _specs(s).where(F.col("form") == form)).select("spec", "name", "id").transform(_shown, "id")


@query
def lookup_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, "bare")


@query
def lookup_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, "file_name")


@query
def lookup_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, "line")


@query
def lookup_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, "module")


@query
def lookup_class_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, "class_method")


# Impact -------------------------------------------------------------------------------------------


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "o_orderkey % 40"
    return table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select(
        F.expr(f"concat('pkg', {m} % 5, '/m', {m}, if({m} % 3 = 0, '.rs', '.py'))").alias("file"),
        F.expr("1 + o_custkey % 400").alias("range_start"), F.expr("1 + o_custkey % 400 + o_orderkey % 5").alias("range_end"),
    )


@query
def impact_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, edges = _edges(spark, sf_dir)
    return I.impact(I.changed_symbols(g.symbols, _ranges(spark, sf_dir)), "changed", edges)


@query
def impact_callers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, edges = _edges(spark, sf_dir)
    return I.impact_callers(I.changed_symbols(g.symbols, _ranges(spark, sf_dir)), edges, g.symbols)


@query
def impact_files_no_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir)
    outside = table(spark, sf_dir, "orders").where("o_orderkey % 1009 = 0").select(
        F.expr("concat('new/n', o_orderkey % 7, '.py')").alias("file"), F.lit(1).cast("bigint").alias("range_start"), F.lit(2).cast("bigint").alias("range_end")
    )
    return I.files_without_symbols(g.symbols, _ranges(spark, sf_dir).union(outside))


@query
def impact_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of deleted files, as they were, with callers in what remains."""
    g, edges = _edges(spark, sf_dir)
    gone = g.symbols.where(r"file like '%/m7.py'")
    return I.impact(gone, "deleted", edges.where(r"file not like '%/m7.py'"))


# Delta --------------------------------------------------------------------------------------------


def _mutated(g: Graph) -> Graph:
    """The corpus after an edit: every 97th symbol renamed, files m7 gone, one file added."""
    renamed = g.symbols.withColumn("name", F.expr("if(id % 97 = 0, concat(name, '_v2'), name)")).where("file not like '%/m7.py'")
    added = g.symbols.where("id = 1").select(
        F.lit(-1).cast("bigint").alias("id"), F.lit("new/extra.py").alias("file"), F.lit(0).cast("bigint").alias("seq"), F.lit("ext_3").alias("name"), F.lit("function").alias("kind"),
        F.lit(None).cast("string").alias("parent_class"), F.lit(1).cast("bigint").alias("start_line"), F.lit(2).cast("bigint").alias("end_line"), F.lit("def ext_3():").alias("signature"),
        "ret_class", F.lit(None).cast("string").alias("base_class"), F.lit(None).cast("string").alias("docstring"), F.lit("python").alias("lang"),
    )
    touched = g.symbols.where("id % 97 = 0").select(F.col("file").alias("path")).distinct().withColumn("touched", F.lit(True))
    kept = g.files.join(touched, "path", "left").withColumn("hash", F.expr("if(touched, concat('edited-', hash), hash)")).drop("touched").where("path not like '%/m7.py'")
    new = g.files.limit(1).select(F.lit("new/extra.py").alias("path"), F.lit("new").alias("hash"), F.lit("python").alias("lang"), F.lit("def ext_3():\n    pass\n").alias("content"))
    out = g.map(lambda n, t: t if n in ("files", "symbols") else t.where("file not like '%/m7.py'")).tables()
    return Graph(**(out | {"symbols": renamed.unionByName(added), "files": kept.unionByName(new)}))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph, DataFrame]:
    before = derived(spark, sf_dir)
    after = _mutated(before)
    return before, after, D.changed_files(before.files, after.files)


@query
def delta_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)[2].where("change <> 'deleted'")


@query
def delta_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)[2].where("change = 'deleted'").select("path")


@query
def delta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph kept by delta; its SQL rebuilds them from the edited corpus."""
    before = derived(spark, sf_dir).map(lambda n, t: saved(t) if n in ("files", "import_names", "call_sites") else t)
    after = _mutated(before)
    changes = joinable(D.changed_files(before.files, after.files))
    alive = changes.where("change <> 'deleted'").select(F.col("path").alias("again"))
    parsed = after.map(lambda n, t: t.join(alive, F.col("path" if n == "files" else "file") == F.col("again"), "left_semi"))
    edges = D.incremental_edges(saved(R.edges_of(before)), before, D.refreshed(before, changes, parsed), changes)
    return edges.groupBy("file", "callee_name", "kind", "rule").agg(F.count("*").alias("edges"), F.sum("seq").alias("seqs"))


@query
def affected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, changes = _changes(spark, sf_dir)
    return D.affected_names(before.symbols, after.symbols, changes)


@query
def delta_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, changes = _changes(spark, sf_dir)
    changes = joinable(changes)
    calls = saved(D.reached_calls(before, after, changes))
    old, new = (R.edges_of(Graph(**(g.tables() | {"call_sites": calls}))) for g in (before, after))
    return D.relabelled(old, new, before.symbols, after.symbols, changes)


# Bundles ------------------------------------------------------------------------------------------


def _tested(g: Graph) -> Graph:
    """File m38 as a test file."""
    move = lambda c: F.regexp_replace(c, "^pkg3/m38", "tests/m38")
    return g.map(lambda n, t: t.withColumn("path", move("path")) if n == "files" else t.withColumn("file", move("file")))


def _tested_edges(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g, edges = _edges(spark, sf_dir)
    return _tested(g), edges.withColumn("file", F.regexp_replace("file", "^pkg3/m38", "tests/m38"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g, edges = _tested_edges(spark, sf_dir)
    return g, B.ranked_callers(edges, g.symbols)


@query
def bundle_callers_tests_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[1].where("place <= 20").select("name", "place", "caller", "resolution", "is_test", "file", "line")


@query
def bundle_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.caller_report(_tested_edges(spark, sf_dir)[1])


@query
def bundle_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, ranked = _ranked(spark, sf_dir)
    return B.with_snippets(ranked.where("place <= 5"), g.symbols, g.files).select("name", "place", "file", "line", "snippet")


# Lines and paths ----------------------------------------------------------------------------------


@query
def doc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.read_span(F.col("text"), F.col("doc_id") % 3, F.col("doc_id") % 3 + 2).alias("span"))


@query
def doc_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.read_snippet(F.col("text"), F.col("doc_id") % 6, 1).alias("snippet"))


@query
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    every = F.when(text == "", F.array(F.lit(""))).otherwise(N.lines(text))  # an empty text shows as one empty line here
    return table(spark, sf_dir, "documents").select("doc_id", N.approx_tokens(text).alias("tokens"), F.size(every).cast("bigint").alias("lines"), F.get(every, 0).alias("first_line"))


@query
def test_file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    base = F.substring_index(path, "/", -1)
    forms = F.array(path, F.concat(F.lit("tests/"), path), F.concat(F.lit("a/test/"), path), F.concat(F.lit("a/test_"), base), F.concat(F.lit("contest/"), path), F.replace(path, F.lit(".py"), F.lit("_test.py")))
    paths = derived(spark, sf_dir).files.select(F.explode(forms).alias("path")).distinct()
    return paths.select("path", N.is_test_file(path).alias("is_test"), N.language_of(path).alias("lang"))


@query
def parse_failures_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = derived(spark, sf_dir).parse_failures
    return failures.groupBy(F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("files"))


# Parsers: a query for each sample of sources, against facts written by hand -----------------------


def _parse_query(sample: str) -> Query:
    return lambda spark, sf_dir: samples.facts(spark, sample)


QUERIES |= {f"parse_{name}": _parse_query(name) for name in samples.SOURCES}
