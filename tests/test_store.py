from __future__ import annotations

import io
import json
import subprocess

import pytest

from graphloom import cli, mcp
from graphloom.render import render_prompt
from graphloom.store import Store, collect_garbage, seed
from graphloom.streaming import feed


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_py", ".py")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "pkg").mkdir()
    (root / "pkg" / "__init__.py").write_text("def hidden():\n    pass\n")
    write(
        root, a_py="def target():\n    '''Says.'''\n    return 1\n\ndef other():\n    return target()\n",
        b_py="from a import target as t\n\ndef use():\n    t()\n    nothing()\n\nt()\n",
        tests__test_a_py="from a import target\n\ndef test_it():\n    x = target()\n" + "    pass\n" * 8 + "    assert x\n",
        bad_py="%% ?? ]) this is { prose ) and ( no source", vendor__skip_py="def target(): pass\n",
    )
    store = Store(spark, root)
    store.index()
    return store


def test_index_and_status(repo):
    assert repo.status() == {"files": 5, "symbols": 5, "imports": 2, "edges": 5, "exact": 4, "ambiguous": 0, "unresolved": 1}
    assert repo.parse_failures() == ["bad.py"]
    assert repo.enumerate("hidden")["def_count"] == 1  # files whose names begin with _ are read


def test_bundle_puts_tests_first_and_tells_what_it_leaves_out(repo):
    b = repo.bundle("target", max_callers=1, budget=5)
    r = b["report"]
    assert b["callers"][0]["is_test"] and b["callers"][0]["call_site"]["snippet"].endswith("assert x")
    assert (r["caller_count"], r["callers_included"], r["test_caller_count"]) == (4, 1, 1)
    assert r["omitted"] == ["a.py:6", "b.py:4", "b.py:7"] and r["over_budget"] and r["unparsed_files"] == ["bad.py"]
    blank = json.loads(json.dumps(b))
    blank["report"] |= {"token_count": 0, "over_budget": False}
    assert r["token_count"] == -(-len(json.dumps(blank, ensure_ascii=False, separators=(",", ":")).encode()) // 4)
    assert b["target"]["docstring"] == "Says." and b["target"]["fq_name"] == "a.target"
    text = render_prompt(b)
    assert "[TEST]" in text and "! 1 files unparsed" in text
    with pytest.raises(LookupError):
        repo.bundle("nobody")


def test_closure_exists_surface(repo):
    c = repo.closure("a.py::target")
    assert [x["caller"] for x in c["callers"]] == ["other", "use", "<module>", "test_it"]
    assert [x["name"] for x in repo.closure("use")["callees"]] == ["target", "nothing"]
    assert len(repo.exists("target")["defs"]) == 1 and repo.exists("Target")["defs"] == []
    assert [d["fq_name"] for d in repo.exists("t", prefix=True)["defs"]] == ["a.target", "tests.test_a.test_it"]
    assert [d["name"] for d in repo.surface("a")["defs"]] == ["target", "other"] and repo.surface("no.such") == {"module": "no.such", "defs": [], "imports": [], "unparsed": False}


def test_mcp(repo):
    asked = [
        '{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"jsonrpc":"2.0","method":"notifications/initialized"}', "not json",
        '{"jsonrpc":"2.0","id":2,"method":"tools/list"}', '{"jsonrpc":"2.0","id":3,"method":"tools/call","params":{"name":"enumerate","arguments":{"symbol":"target"}}}',
        '{"jsonrpc":"2.0","id":4,"method":"tools/call","params":{"name":"bundle","arguments":{"symbol":"nobody"}}}', '{"jsonrpc":"2.0","id":5,"method":"nope"}',
    ]
    out = io.StringIO()
    mcp.serve(repo, io.StringIO("\n".join(asked)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, None, 2, 3, 4, 5]
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" and got[1]["error"]["code"] == -32700 and len(got[2]["result"]["tools"]) == 3
    assert json.loads(got[3]["result"]["content"][0]["text"])["caller_count"] == 4
    assert got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601


def test_refresh_seed_impact_and_command_line(spark, tmp_path, capsys):
    one, two = tmp_path / "one", tmp_path / "two"
    for root in (one, two):
        write(root, a_py="def f():\n    return 1\n", b_py="def g():\n    f()\n", c_py="def gone():\n    f()\n")
    git = lambda *a: subprocess.run(["git", "-C", str(one), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "x")
    store = Store(spark, one)
    assert store.refresh()["changed"] == 3
    write(one, a_py="def f2():\n    return 1\n")
    assert store.refresh() == {"changed": 1, "deleted": 0, "relabeled": 2}
    write(one, a_py="def f():\n    return 1\n")  # taken back: git sees no change, the hash does
    assert store.refresh() == {"changed": 1, "deleted": 0, "relabeled": 2}
    write(one, a_py="def f():\n    return 2\n")
    (one / "c.py").unlink()
    args = cli._arguments().parse_args(["impact", str(one), "--diff", "HEAD"])
    got = json.loads(cli.run(args, spark))
    assert [(e["fq_name"], e["status"], e["caller_count"]) for e in got["changed_symbols"]] == [("a.f", "changed", 1), ("c.gone", "deleted", 0)]
    assert cli.run(cli._arguments().parse_args(["status", str(one)]), spark).startswith("store: 2 files, 2 symbols")
    write(two, b_py="def g():\n    f()\n    f()\n")
    assert seed(spark, two, one)["changed"] == 3  # a.py and b.py differ, c.py is there again
    with pytest.raises(ValueError):
        seed(spark, two, one)
    fresh = Store(spark, two)
    before = fresh.status()
    assert fresh.index() == before
    meta = json.loads((fresh.home / "meta.json").read_text())
    (fresh.home / "meta.json").write_text(json.dumps(meta | {"version": 999}))
    assert Store(spark, two).status()["files"] == 0
    with pytest.raises(ValueError):
        collect_garbage(two, False)
    assert collect_garbage(two, True).startswith("removed") and collect_garbage(two, True).startswith("nothing")
    assert cli.main(["parse", "x.unknown"]) == 1 and "supported: .py" in capsys.readouterr().err


def test_open_refuses_what_is_no_folder(spark, tmp_path):
    (tmp_path / "file").write_text("")
    (tmp_path / ".graphloom").write_text("")
    for root in (tmp_path / "missing", tmp_path / "file", tmp_path):
        with pytest.raises(ValueError):
            Store(spark, root)


def test_change_feed(spark, tmp_path):
    source, table, mark = (tmp_path / x for x in ("feed", "table", "mark"))
    source.mkdir()
    for number, lines in enumerate([[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 1, "late"), ("b", 2, None)]]):
        (source / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("path", "version", "content"), r, strict=True))) for r in lines))
        feed.follow(spark, f"file://{source}", f"file://{table}", f"file://{mark}").awaitTermination()
    rows = spark.read.parquet(f"file://{table}/batch=1").collect()
    assert sorted((r["path"], r["version"], r["content"]) for r in rows) == [("a", 2, "y"), ("b", 2, None)]
