from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql.functions import lit

import corpus_pipeline
from graphloom.llm.secrets import find_secrets, redact
from graphloom.llm.shared import written
from tests.llm import test_decontaminate, test_jaccard
from tests.llm.conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, copies, leaks, junk and secrets."""
    r, root = random.Random(11), tmp_path_factory.mktemp("sf")
    clean = [prose(r, r.randrange(60, 150)) for _ in range(120)]
    item = prose(r, 25)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(clean)]
    rows += [(200 + i, clean[i], "en", "s0") for i in range(6)]
    rows += [(210 + i, " ".join("zz" if r.random() < 0.04 else w for w in clean[i].split()), "en", "s1") for i in range(6)]
    rows += [(300 + i, f"{prose(r, 40)} {item} {prose(r, 30)}", "en", "s2") for i in range(4)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(r, 80).split()), "en", "s1") for i in range(40)]
    rows += [(500, f'{prose(r, 50)} token = "{r.randbytes(20).hex()}" {prose(r, 20)}', "en", "s0"), (501, None, "en", None), (502, "", None, "s0"), (None, prose(r, 70), "en", "s2")]
    docs = [(*x, len(x[1]) if x[1] is not None else None) for x in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(400 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_decisions_take_effect_and_clean_documents_stay(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in out}
    assert set(range(120)) <= ids and 500 in ids and None in ids
    assert not ids & ({*range(200, 206), *range(210, 216), *range(300, 304), *range(400, 440)})
    masked = next(r for r in out if r["doc_id"] == 500)
    assert "[hex_secret]" in masked["text"] and not find_secrets(masked["text"]) and masked["n_chars"] == len(masked["text"])


@pytest.mark.parametrize("stage", range(5))
def test_stages_return_the_columns_of_documents(spark, folder, none, odd, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    f = corpus_pipeline.STAGES[stage][1]
    added = ["mix_task", "mix_block", "mix_epoch", "mix_release", "mix_deadline", "mix_slot", "mix_rank"] if stage == 4 else []
    assert f(spark, docs, folder).columns == docs.columns + added
    assert f(spark, none, folder).count() == 0
    assert [c for c in f(spark, odd, folder).columns if c not in added] == [c for c in odd.columns if c not in added]


def test_every_stage_is_that_of_brute_force(spark, folder):
    """From what the first stage keeps, whose posteriors have a test of their own, to the mixture."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = written(stages["quality classifier"](spark, docs, folder), "q")
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in test_jaccard.brute(rows):
        x, y = sorted((find(a), find(b)))
        if x != y:
            top[y] = x
    rows = [(i, t) for i, t in rows if i is None or find(i) == i]
    now = written(stages["n-gram Jaccard join"](spark, now, folder), "j")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in now.collect()))) == sorted(map(repr, rows))
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in test_decontaminate.brute([(k, t) for k, (_, t) in enumerate(rows)], items, 8)}
    rows = [x for k, x in enumerate(rows) if k not in leaks]
    now = written(stages["benchmark decontamination"](spark, now, folder), "d")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in now.collect()))) == sorted(map(repr, rows))
    rows = [(i, redact(t)) for i, t in rows]
    now = written(stages["secret scans"](spark, now, folder), "s")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in now.collect()))) == sorted(map(repr, rows))
    mixed = stages["mixing sources to target weights"](spark, now, folder).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in mixed if r["mix_epoch"] == 0))) == sorted(map(repr, rows))


def test_other_columns_and_empty_tables_go_through_all_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: lit("x") for c in ("mix_notes", "q_logit", "component", "doc", "site_host", "c0")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert set(range(120)) | {*range(300, 304), None} <= ids and not ids & set(range(200, 206))


def test_entry_works_without_the_pipeline():
    import __spark_entry__ as entry

    assert {"pipeline", "op1_mix_sources", "op9_ngram_jaccard", "enumerate_all"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    text = Path(corpus_pipeline.__file__).read_text()
    assert "except" not in text
