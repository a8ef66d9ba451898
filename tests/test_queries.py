from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.functions import names as N
from graphloom.operators import delta as D
from graphloom.plans import oracles, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(oracles.ORACLES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert Counter(rows) == Counter(want)


def test_lines_and_spans(spark):
    df = spark.createDataFrame([("a\nb\r\nc\n",), ("",), (None,), ("x",)], "t string")
    t = F.col("t")
    got = df.select(N.read_span(t, F.lit(2), F.lit(9)).alias("a"), N.read_snippet(t, F.lit(1), 1).alias("b"), N.read_span(t, F.lit(5), F.lit(9)).alias("c"), N.approx_tokens(t).alias("d")).collect()
    assert [tuple(r) for r in got] == [("b\nc", "a\nb", "", 2), ("", "", "", 0), ("", "", "", None), ("", "x", "", 1)]


def test_names(spark):
    df = spark.createDataFrame([("src/p/mod.py", "m", "C"), ("plain.py", "top", None), ("a.b/c.txt", "x", None)], "f string, n string, c string")
    assert [r[0] for r in df.select(N.fq_name(F.col("f"), F.col("n"), F.col("c"))).collect()] == ["p.mod.C.m", "plain.top", "a.b.c.txt.x"]
    assert [r[0] for r in df.select(N.path_suffixes(F.col("f"))).collect()][0] == ["src/p/mod.py", "p/mod.py", "mod.py"]


def test_tokens_of_texts_without_lines_are_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "\n"), (3, "a\nb\n"), (4, None), (5, "\n\nc")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["doc_tokens"](spark, str(tmp_path))
    columns = sorted(got.columns)
    sql = oracles.ORACLES["doc_tokens"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)


def _shuffles_of_calls(df) -> int:
    """Exchanges that rows of lineitem go through before they are aggregated or cut to the first of a group."""

    def walk(node) -> tuple[int, bool] | None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if name.startswith("Scan parquet"):
            return (0, True) if "l_orderkey" in node.output().mkString(",") else None
        children = node.children()
        below = next(filter(None, (walk(children.apply(i)) for i in range(children.size()))), None)
        if below is None:
            return None
        count, whole = below
        whole = whole and "Aggregate" not in name and name != "WindowGroupLimit"
        return count + (whole and name == "Exchange"), whole

    return walk(df._jdf.queryExecution().executedPlan())[0]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["resolve_edges", "bundle_callers_tests_first", "closure_callers", "closure_callees", "impact_callers_capped", "bundle_omitted", "bundle_snippets", "base_hop", "external_receivers", "same_file_last_def", "receiver_resolve", "label_by_call_kind", "label_totals", "rule_histogram", "status_counts", "top_externals", "enumerate_all", "import_resolve"])
def test_calls_are_shuffled_twice(spark, name):
    """To the definition that they call and to their file; where lookups are few, nothing else moves them, whatever Spark thinks of sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles_of_calls(registry.QUERIES[name](spark, DATA)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["resolve_edges", "delta_edges"])
def test_rows_are_the_same_where_lookups_are_many(spark, duck, monkeypatch, name):
    monkeypatch.setattr(session, "FEW", 0)
    test_rows_are_those_of_the_sql(spark, duck, name)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_relabelling_looks_at_reached_calls_only(spark):
    g, after, changes = registry._changes(spark, DATA)
    few = changes.where("path = 'pkg0/m0.rs'")
    calls, all_ = D.reached_calls(g, after, few), g.call_sites.count()
    assert 0 < calls.count() < all_ and calls.where("file = 'pkg0/m0.rs'").isEmpty()
    assert all(f.endswith(".parquet") for f in session.saved(few).inputFiles())
