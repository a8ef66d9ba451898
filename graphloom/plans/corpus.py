"""A symbol graph derived from the star-schema tables, with no source text needed.

Parts are symbols, lineitems are call sites, orders give aliases and diff ranges, documents give file
contents. SURVEY and FIXTURES describe the formulas; SQL for the same corpus is in plans.oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schema import Graph
from graphloom.session import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of a part's key k; m is k div 4 % 40, which decides on the package too.
_M = "k div 4 % 40"
_FILE = f"concat('pkg', {_M} % 5, '/m', {_M}, if({_M} % 3 = 0, '.rs', '.py'))"
_LANG = f"if({_M} % 3 = 0, 'rust', 'python')"
_START = "k div 160 * 40 + case k % 4 when 0 then 1 when 1 then 3 when 2 then 14 else 31 end"


def _symbols(part: DataFrame) -> DataFrame:
    k = (
        part.select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("base"), "p_size", "p_brand")
        .withColumns({"role": F.expr("k % 4"), "top": F.expr("k div 160 * 40"), "lang": F.expr(_LANG), "file": F.expr(_FILE)})
        .withColumn("name", F.expr("case role when 0 then concat('C_', base, '_', p_size) when 3 then concat('f_', base) else base end"))
    )
    count = part.agg(F.count("*").alias("n"))  # one row
    owners = k.where("role = 0").select(F.col("k").alias("owner"), F.col("name").alias("owner_name"))
    bases = owners.select(F.col("owner").alias("base_id"), F.col("owner_name").alias("base_class"))
    joined = (
        k.crossJoin(F.broadcast(count))
        .withColumn("base_id", F.expr("if(role = 0 and k % 3 <> 0, 7 * k % n - 7 * k % n % 4, null)"))
        .join(owners, F.expr("role in (1, 2) and owner = k - role"), "left")
        .join(bases, "base_id", "left")
    )
    return joined.select(
        F.col("k").alias("id"), "file", F.col("k").alias("seq"), "name", F.expr("if(role = 0, 'class', 'function')").alias("kind"),
        F.col("owner_name").alias("parent_class"), F.expr(_START).alias("start_line"),
        F.expr("top + case role when 0 then 30 when 1 then 12 when 2 then 28 else 39 end").alias("end_line"),
        F.expr("concat(if(role = 0, 'class ', 'def '), name, if(role = 0, ':', '():'))").alias("signature"),
        F.lit(None).cast("string").alias("ret_class"), "base_class", F.expr("if(k % 2 = 0, concat('Made by ', p_brand), null)").alias("docstring"), "lang",
    )


def _call_sites(lineitem: DataFrame, symbols: DataFrame, n: DataFrame) -> DataFrame:
    """Items are shuffled twice, as few columns: to what they call, and to their file, where callers are found and calls numbered.

    Symbols are as many as parts, so none of this waits for a broadcast of them; only 50 can be `other`. Callers go
    among the items: a join by file and key would be a shuffle of its own, as the numbering is by file.
    """
    s = symbols.select("id", "file", "name", "kind", "parent_class")
    called = s.select(F.col("id").alias("callee"), F.col("name").alias("callee_name"), F.expr("coalesce(parent_class, if(kind = 'class', name, null))").alias("callee_class"))
    other = s.where("id % 4 = 0 and id between 0 and 196").select(F.col("id").alias("other"), F.col("name").alias("other_class"))
    items = (
        lineitem.crossJoin(F.broadcast(n))
        .select(
            "l_orderkey", F.col("l_partkey").alias("k"), "l_suppkey", "l_linenumber", F.expr("coalesce(l_returnflag = 'N', false)").alias("func"),
            F.expr("(31 * l_orderkey + 7 * l_suppkey + l_linenumber) % (5 * n div 4)").alias("callee"), F.expr("4 * (l_orderkey % 50)").alias("other"),
            F.expr("case when l_returnflag <> 'R' then 0 when l_suppkey % 4 = 0 then 1 when l_suppkey % 4 = 1 then 2 when l_linestatus = 'F' then 3 else 4 end").alias("receiver"),
        )
        .join(called.hint("shuffle_hash"), "callee", "left").join(F.broadcast(other), "other", "left")
        .select(
            F.expr(_FILE).alias("file"), "k", "l_orderkey", "l_suppkey", "l_linenumber", "func", F.expr("coalesce(callee_name, concat('ext_', l_orderkey % 17))").alias("name"),
            F.expr("case receiver when 0 then null when 1 then 'dict' when 2 then 'Pool' when 3 then coalesce(callee_class, 'Nope') else coalesce(other_class, 'Nope') end").alias("receiver_class"),
        )
    )
    callers = s.select("file", F.col("id").alias("k"), F.struct(F.col("name").alias("enclosing")).alias("caller"))
    found = F.collect_list("caller").over(Window.partitionBy("file", "k"))  # one, or none where no part has the key
    placed = items.unionByName(callers, allowMissingColumns=True).repartition("file").withColumn("callers", found).where("func is not null")
    order = "l_orderkey, l_linenumber, l_suppkey, k, name, not func, receiver_class"
    return placed.withColumn("caller", F.explode("callers")).select(
        "file", F.expr(f"row_number() over (partition by file order by {order})").cast("bigint").alias("seq"), F.expr(_LANG).alias("lang"), "caller.enclosing", "name",
        F.expr(f"{_START} + 1 + l_linenumber").alias("line"), F.expr("if(func, 'func', 'method')").alias("call_kind"), "receiver_class",
    )


def _import_names(symbols: DataFrame) -> DataFrame:
    files = symbols.select("file", "lang").distinct()
    targets = symbols.where("kind = 'function' and id < 400").select("id", "name", F.col("file").alias("from_file"))
    named = (
        files.select("file").join(targets, F.expr("(length(file) + id) % 11 = 0"))
        .select("file", F.col("id").alias("seq"), F.col("name").alias("local"),
                F.expr("if(id % 5 = 0, 'nowhere.mod', replace(regexp_replace(from_file, '[.](py|rs)$', ''), '/', '.'))").alias("source_module"))
    )
    pool = files.where("lang = 'python'").select("file", F.lit(0).cast("bigint").alias("seq"), F.lit("Pool").alias("local"), F.lit("ext.sdk").alias("source_module"))
    return named.unionByName(pool)


def _aliases(orders: DataFrame, symbols: DataFrame, n: DataFrame) -> DataFrame:
    home = symbols.select(F.col("id").alias("home"), "file")
    source = symbols.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return (
        orders.where("o_orderkey % 11 = 0").crossJoin(F.broadcast(n))
        .select("o_orderkey", F.expr("o_custkey % n").alias("home"), F.expr("13 * o_custkey % n").alias("source_id"))
        .join(home, "home").join(source, "source_id")
        .select("file", F.col("o_orderkey").alias("seq"), F.expr("concat('ext_', o_orderkey % 17)").alias("local"), "source")
    )


def derived(spark: SparkSession, sf_dir: str, aliased: bool = False) -> Graph:
    """The graph; aliases are left out unless `aliased`."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    symbols = saved(_symbols(part))
    names = _import_names(symbols)
    aliases = _aliases(table(spark, sf_dir, "orders"), symbols, n)
    documents = table(spark, sf_dir, "documents").where("doc_id between 0 and 199").select("doc_id", F.col("text").alias("content"))  # m * 5 + p is at most 39 * 5 + 4
    paths = symbols.select(F.col("file").alias("path"), "lang").distinct().withColumn("doc_id", F.expr("bigint(regexp_extract(path, 'm([0-9]+)', 1)) * 5 + bigint(regexp_extract(path, 'pkg([0-9]+)', 1))"))
    files = paths.join(documents, "doc_id", "left").select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), "lang", "content")
    return Graph(
        files=files,
        symbols=symbols,
        imports=names.select("file", "seq", F.expr("concat('from ', source_module, ' import ', local)").alias("raw"), F.expr("1 + seq % 50").alias("line")),
        import_names=names,
        aliases=aliases if aliased else aliases.limit(0),
        call_sites=_call_sites(table(spark, sf_dir, "lineitem"), symbols, n),
        parse_failures=paths.where("bigint(regexp_extract(path, 'm([0-9]+)', 1)) % 13 = 0").select(
            F.col("path").alias("file"), F.lit("suspect: parsed with zero defs/calls/imports for a non-empty file").alias("error")
        ),
    )
