"""Resolution: every call site becomes one edge of one label.

Symbols are aggregated into lookup tables that have at most one row for a key, and call sites are left
joined to them, so no call site is lost or doubled; one CASE then orders the rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import BUILTINS, dotted_file, path_matches, path_suffixes
from graphloom.schema import Graph
from graphloom.session import few, joinable, saved

#: Rule -> label.
RULES: dict[str, str] = {
    "U": "unresolved", "EXT": "unresolved", "RC": "exact", "A_RC": "ambiguous", "BASE": "exact", "IMP": "exact",
    "A_IMP": "ambiguous", "SAME": "exact", "MOD": "exact", "A_MOD": "ambiguous", "ONE": "exact", "A": "ambiguous",
}


def expand_aliases(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """calls with callee_name: the source of the file's last alias of that local name, else the name itself."""
    last = joinable(aliases.groupBy(F.col("file").alias("al_file"), F.col("local").alias("al_local")).agg(F.max_by("source", "seq").alias("al_source")))
    on = (F.col("file") == F.col("al_file")) & (F.col("name") == F.col("al_local"))
    return calls.join(last, on, "left").withColumn("callee_name", F.coalesce("al_source", "name")).drop("al_file", "al_local", "al_source")


class Index(NamedTuple):
    """Definitions by name, lang, file and class, which all lookups are made of, and whether they are few enough to be broadcast."""

    rows: DataFrame
    small: bool

    def sent(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table


def indexed(symbols: DataFrame) -> Index:
    at = F.struct("seq", "id")
    rows = saved(
        symbols.groupBy("name", "lang", "file", F.col("parent_class").alias("parent")).agg(
            F.count("*").alias("n"), F.min("id").alias("one"), F.min(at).alias("first"), F.max(at).alias("last"), F.min("kind").alias("kind"), F.min("base_class").alias("base")
        )
    )
    return Index(rows, few(rows))


def attribute_callers(calls: DataFrame, symbols: DataFrame, index: Index | None = None) -> DataFrame:
    """calls with caller_id: the first definition in the file with the enclosing name, or null."""
    index = index or indexed(symbols)
    first = index.rows.groupBy(F.col("file").alias("cl_file"), F.col("name").alias("cl_name")).agg(F.min("first")["id"].alias("caller_id"))
    on = (F.col("file") == F.col("cl_file")) & (F.col("enclosing") == F.col("cl_name"))
    return calls.join(index.sent(first), on, "left").drop("cl_file", "cl_name")


def first_imports(import_names: DataFrame) -> DataFrame:
    """(file, local, source_module) of the first import of each local name in a file."""
    return import_names.groupBy("file", "local").agg(F.min_by("source_module", F.struct("seq", "source_module")).alias("source_module"))


def _by(rows: DataFrame, keys: dict[str, str], prefix: str, *more: Column) -> DataFrame:
    """One row a key of an index's rows: keys maps columns to new names; <prefix>_n definitions, <prefix>_one an id."""
    return rows.groupBy(*(F.col(c).alias(n) for c, n in keys.items())).agg(F.sum("n").alias(f"{prefix}_n"), F.min("one").alias(f"{prefix}_one"), *more)


def _scattered(name: str) -> Column:
    """The column, with nulls as a thousand names that nothing has: most calls have no receiver, and in a join by it they would meet in one partition."""
    return F.coalesce(F.col(name), F.concat(F.lit("\0"), F.pmod(F.xxhash64("file", "seq"), F.lit(1000)).cast("string")))


def resolve(calls: DataFrame, graph: Graph, index: Index | None = None) -> DataFrame:
    """calls (with callee_name) and callee_id, kind, rule.

    Calls are many times the lookups' rows: where these are few they are broadcast, and calls stay where they are.
    """
    index = index or indexed(graph.symbols)
    module_level, methods = index.rows.where("parent is null"), index.rows.where("parent is not null")
    suffixes = graph.files.select(F.col("path").alias("sf_file"), F.explode(path_suffixes(F.col("path"))).alias("sf_suffix"))
    # One lookup of a name serves callees (of any level, and of modules), receivers and bases.
    top = F.col("parent").isNull()
    named = _by(
        index.rows, {"name": "c_name", "lang": "c_lang"}, "c", F.sum(F.when(top, F.col("n"))).alias("m_n"), F.min(F.when(top, F.col("one"))).alias("m_one"), F.min("kind").alias("c_kind"), F.min("base").alias("c_base")
    )

    def as_(prefix: str, *columns: str) -> DataFrame:
        return named.select(*(F.col(f"c_{c}").alias(f"{prefix}_{c}") for c in ("name", "lang", "n", *columns)))

    with_base = (F.col("r_base") == F.col("b_name")) & (F.col("r_lang") == F.col("b_lang"))
    receivers = as_("r", "kind", "base").join(as_("b", "kind"), with_base, "left")
    own = _by(methods, {"name": "p_name", "lang": "p_lang", "parent": "p_parent"}, "p")
    inherited = _by(methods, {"name": "h_name", "lang": "h_lang", "parent": "h_parent"}, "h")
    same = _by(module_level, {"name": "s_name", "lang": "s_lang", "file": "s_file"}, "s", F.max("last")["id"].alias("s_last"))
    imported = _by(module_level.join(suffixes, F.col("file") == F.col("sf_file")), {"name": "i_name", "lang": "i_lang", "sf_suffix": "i_suffix"}, "i")
    imports = saved(first_imports(graph.import_names))
    of_name = imports.select(F.col("file").alias("im_file"), F.col("local").alias("im_local"), dotted_file(F.col("source_module")).alias("im_path"))
    inside = suffixes.select(F.col("sf_suffix").alias("in_path")).distinct().withColumn("in_repo", F.lit(True))
    of_receiver = (
        imports.select(F.col("file").alias("x_file"), F.col("local").alias("x_local"), dotted_file(F.col("source_module")).alias("x_path"))
        .join(inside, F.col("x_path") == F.col("in_path"), "left")
        .select("x_file", "x_local", F.col("in_repo").isNull().alias("x_external"))
    )
    if few(imports):
        of_name, of_receiver = F.broadcast(of_name), F.broadcast(of_receiver)

    def at(name: str, lang: str, *more: Column) -> Column:
        on = (F.col("callee_name") == F.col(name)) & (F.col("lang") == F.col(lang))
        for m in more:
            on = on & m
        return on

    func, method = F.col("call_kind") == "func", F.col("call_kind") == "method"
    rc = F.col("receiver_class")
    joined = (
        calls.withColumn("r_key", rc if index.small else _scattered("receiver_class")).join(index.sent(named), at("c_name", "c_lang"), "left")
        .join(index.sent(same), at("s_name", "s_lang", F.col("file") == F.col("s_file"), func), "left")
        .join(of_name, (F.col("file") == F.col("im_file")) & (F.col("callee_name") == F.col("im_local")) & func, "left")
        .join(index.sent(imported), at("i_name", "i_lang", F.col("im_path") == F.col("i_suffix")), "left")
        .join(index.sent(receivers), (F.col("r_key") == F.col("r_name")) & (F.col("lang") == F.col("r_lang")) & method, "left")
        .join(index.sent(own), at("p_name", "p_lang", rc == F.col("p_parent"), method), "left")
        .join(index.sent(inherited), at("h_name", "h_lang", F.col("r_base") == F.col("h_parent")), "left")
        .join(of_receiver, (F.col("file") == F.col("x_file")) & (rc == F.col("x_local")) & method, "left")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    one_class = (F.col("r_n") == 1) & (F.col("r_kind") == "class")
    # Of the files that the import may mean, and the caller's own file, which may be one of them.
    overlap = path_matches(F.col("file"), F.col("im_path"))
    n_import = n("i_n") + F.when(overlap, 0).otherwise(n("s_n"))
    only_import = F.when(n("i_n") == 1, F.col("i_one")).otherwise(F.col("s_one"))
    external = (F.col("lang") == "python") & (rc.isin(*BUILTINS) | F.coalesce(F.col("x_external"), F.lit(False)))
    rules: list[tuple[str, Column, Column]] = [
        ("U", F.col("c_n").isNull(), F.lit(None)),
        ("EXT", method & rc.isNotNull() & F.col("r_n").isNull() & (F.col("c_n") > 1) & external, F.lit(None)),
        ("RC", method & one_class & (n("p_n") == 1), F.col("p_one")),
        ("A_RC", method & one_class & (n("p_n") > 1), F.lit(None)),
        ("BASE", method & one_class & (F.col("b_n") == 1) & (F.col("b_kind") == "class") & (F.col("h_n") == 1), F.col("h_one")),
        ("IMP", func & F.col("im_path").isNotNull() & (n_import == 1), only_import),
        ("A_IMP", func & F.col("im_path").isNotNull() & (n_import > 1), F.lit(None)),
        ("SAME", func & (n("s_n") > 0), F.col("s_last")),
        ("MOD", func & (n("m_n") == 1), F.col("m_one")),
        ("A_MOD", func & (n("m_n") > 1), F.lit(None)),
        ("ONE", F.col("c_n") == 1, F.col("c_one")),
    ]
    rule = target = None
    for name, when, then in rules:
        rule = F.when(when, name) if rule is None else rule.when(when, name)
        target = F.when(when, then) if target is None else target.when(when, then)
    labels = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))
    out = joined.select(*calls.columns, target.cast("bigint").alias("callee_id"), rule.otherwise("A").alias("rule"))
    return out.withColumn("kind", labels[F.col("rule")])


def edges_of(graph: Graph, *more: str) -> DataFrame:
    """One row for each call site: file, seq, line, lang, caller_id, callee_id, callee_name, kind, rule, call_kind, receiver_class, name; more: other columns of call sites."""
    index = indexed(graph.symbols)
    calls = attribute_callers(expand_aliases(graph.call_sites, graph.aliases), graph.symbols, index)
    return edges_of_calls(calls, graph, *more, index=index)


def edges_of_calls(calls: DataFrame, graph: Graph, *more: str, index: Index | None = None) -> DataFrame:
    """Edges of calls that have callee_name and caller_id; see edges_of()."""
    return resolve(calls, graph, index).select("file", "seq", "line", "lang", "caller_id", "callee_id", "callee_name", "name", "kind", "rule", "call_kind", "receiver_class", *more)
