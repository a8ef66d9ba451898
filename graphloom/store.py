"""A graph kept beside its source tree, and its questions for one symbol as nested records."""

from __future__ import annotations

import json
import os
import shutil
import sys
import time
from contextlib import contextmanager
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import fq_name
from graphloom.operators import bundle as B
from graphloom.operators import delta as D
from graphloom.operators import impact as I
from graphloom.operators import queries as Q
from graphloom.operators.resolve import edges_of
from graphloom.schema import Graph
from graphloom.session import importable
from graphloom.sources import git, tree

#: Layout of a snapshot; another one on disk is dropped.
VERSION = 1
Record = dict[str, Any]


class Tokenizer(Protocol):
    name: str

    def count(self, text: str) -> int: ...


class ApproxTokenizer:
    """A quarter of the bytes, rounded up."""

    name = "approx"

    def count(self, text: str) -> int:
        return -(-len(text.encode()) // 4)


def _rows(df: DataFrame) -> list[Record]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Store:
    """Snapshots below <root>/.graphloom: a table of parsed files, a table of edges, and a pointer that is swapped."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = importable(spark), Path(root).resolve()
        if not self.root.exists():
            raise ValueError(f"no such folder: {root}")
        if not self.root.is_dir():
            raise ValueError(f"not a folder: {root}")
        self.home = self.root / tree.STORE
        if self.home.exists() and not self.home.is_dir():
            raise ValueError(f"{self.home} is not a folder")
        self.home.mkdir(exist_ok=True)
        if self.meta and self.meta.get("version") != VERSION:
            print(f"store version {self.meta.get('version')} is not {VERSION}: starting anew", file=sys.stderr)
            self.drop()

    # Snapshots ----------------------------------------------------------------------------------

    @property
    def meta(self) -> Record:
        try:
            return json.loads((self.home / "meta.json").read_text())
        except (FileNotFoundError, ValueError):
            return {}

    def drop(self) -> None:
        for p in self.home.iterdir():
            shutil.rmtree(p) if p.is_dir() else p.unlink()

    @contextmanager
    def writing(self, wait: float = 60.0):
        """One writer at a time; a lock of a dead process is taken over."""
        lock, until = self.home / "lock", time.monotonic() + wait
        while True:
            try:
                fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, str(os.getpid()).encode())
                os.close(fd)
                break
            except FileExistsError:
                try:
                    os.kill(int(lock.read_text() or 0), 0)
                except (ProcessLookupError, ValueError):
                    lock.unlink(missing_ok=True)
                    continue
                except (FileNotFoundError, PermissionError):
                    pass
                if time.monotonic() > until:
                    raise TimeoutError(f"{lock} is held by another process") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"file://{self.home}/{self.meta['snapshot']}/{name}")

    @property
    def graph(self) -> Graph:
        if "snapshot" not in self.meta:
            return tree.graph_of(self.spark.createDataFrame([], tree.PARSED))
        return tree.graph_of(self._read("parsed"))

    @property
    def edges(self) -> DataFrame:
        return self._read("edges") if "snapshot" in self.meta else edges_of(self.graph)

    def _save(self, parsed: DataFrame, changes: DataFrame | None = None) -> None:
        """Write a snapshot, then point to it; older ones go. With changes, edges that they can't reach are taken over."""
        name = f"snapshot-{time.time_ns()}"
        base = f"file://{self.home}/{name}"
        parsed.sort("path").write.parquet(f"{base}/parsed")
        graph = tree.graph_of(self.spark.read.parquet(f"{base}/parsed"))
        edges = edges_of(graph) if changes is None else D.incremental_edges(self.edges, self.graph, graph, changes)
        edges.sort("callee_name", "file", "seq").write.parquet(f"{base}/edges")
        pending = self.home / "meta.json.tmp"
        pending.write_text(json.dumps({"version": VERSION, "snapshot": name, "last_indexed_head": git.head(self.root)}))
        before = self.meta.get("snapshot")
        os.replace(pending, self.home / "meta.json")
        self.spark.catalog.clearCache()
        for p in self.home.glob("snapshot-*"):
            if p.name not in (name, before):
                shutil.rmtree(p, ignore_errors=True)

    def _failed_folders(self, failed: list[tuple[str, str]]) -> DataFrame:
        rows = [(p, None, None, None, e, [], [], [], [], []) for p, e in failed]
        return self.spark.createDataFrame(rows, tree.PARSED)

    def index(self) -> Record:
        """Read everything; counts of what there is."""
        paths, failed = tree.list_sources(self.root)
        with self.writing():
            self._save(tree.parsed(self.spark, self.root, paths).unionByName(self._failed_folders(failed)))
        return self.status()

    def refresh(self) -> Record:
        """Bring the graph to what is on disk: only changed files are parsed, and only edges that they can reach are resolved anew.

        Every file is hashed, so edits that were taken back, files outside git and moved heads are all seen.
        """
        if "snapshot" not in self.meta:
            stats = self.index()
            return {"changed": stats["files"], "deleted": 0, "relabeled": 0}
        paths, failed = tree.list_sources(self.root)
        with self.writing():
            stored = self._read("parsed")
            disk = tree.hashes(self.spark, self.root, paths).union(self.spark.createDataFrame(failed, "path string, hash string").withColumn("hash", F.lit(None).cast("string")))
            mark = lambda t: t.select("path", F.coalesce("hash", F.lit("-")).alias("hash"))
            changes = {r["path"]: r["change"] for r in D.changed_files(mark(stored), mark(disk)).collect()}
            gone = [p for p, c in changes.items() if c == "deleted"]
            again = sorted(set(changes) - set(gone))
            if not changes:
                return {"changed": 0, "deleted": 0, "relabeled": 0}
            old_edges, old_symbols = self._read("edges"), tree.graph_of(stored).symbols
            table = self.spark.createDataFrame(list(changes.items()), "path string, change string")
            folders = [(p, e) for p, e in failed if p in changes]
            fresh = tree.parsed(self.spark, self.root, [p for p in again if not p.endswith("/")]).unionByName(self._failed_folders(folders))
            self._save(stored.join(table.select("path"), "path", "left_anti").unionByName(fresh), table)
            relabelled = D.relabelled(old_edges, self.edges, old_symbols, self.graph.symbols, table).count()
        return {"changed": len(again), "deleted": len(gone), "relabeled": relabelled}

    # Questions ----------------------------------------------------------------------------------

    def status(self) -> Record:
        row = Q.status(self.graph, self.edges).first().asDict()
        return {k: row[k] for k in ("files", "symbols", "imports", "edges", "exact", "ambiguous", "unresolved")}

    def parse_failures(self) -> list[str]:
        return [r["file"] for r in self.graph.parse_failures.select("file").orderBy("file").collect()]

    def targets(self, spec: str) -> tuple[str, list[Record]]:
        """(bare name, definitions) of a target spec."""
        symbols = self.graph.symbols
        found = Q.lookup(symbols, self.spark.createDataFrame([(spec,)], "spec string")).select(F.col("name").alias("asked"), "id")
        defs = symbols.withColumn("fq_name", fq_name(F.col("file"), F.col("name"), F.col("parent_class")))
        rows = _rows(found.join(defs, "id", "left").orderBy("file", "start_line", "seq"))
        return rows[0]["asked"], [r for r in rows if r["id"] is not None]

    def _callers(self, name: str) -> list[Record]:
        edges = self.edges.where(F.col("callee_name") == name)
        return _rows(Q.callers(edges, self.graph.symbols).orderBy("file", "line", "seq"))

    def closure(self, spec: str, depth: int = 1) -> Record:
        """Definitions, callers by bare name, callees of the definitions found. depth is told back; the closure is of depth 1."""
        name, targets = self.targets(spec)
        symbols, callees = self.graph.symbols, []
        if targets:
            place = {t["id"]: k for k, t in enumerate(targets)}
            of = self.edges.where(F.col("caller_id").isin(list(place)))
            to = symbols.select(F.col("id").alias("callee_id"), F.struct("file", "start_line", "signature", "docstring").alias("to"))
            for r in sorted(_rows(of.join(to, "callee_id", "left")), key=lambda r: (place[r["caller_id"]], r["seq"])):
                if r["callee_name"] not in {c["name"] for c in callees}:
                    callees.append({"name": r["callee_name"], "resolution": r["kind"], **(r["to"] or dict.fromkeys(("file", "start_line", "signature", "docstring")))})
        return {
            "symbol": name, "depth": depth, "targets": [_symbol(t) for t in targets],
            "callers": [{"caller": r["caller"], "file": r["file"], "line": r["line"], "resolution": r["kind"]} for r in self._callers(name)],
            "callees": callees,
        }

    def enumerate(self, spec: str) -> Record:
        name, targets = self.targets(spec)
        edges = self.edges.where(F.col("callee_name") == name)
        row = edges.agg(F.count("*").alias("n"), F.countDistinct("file").alias("f"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "ambiguous", "unresolved"))).first()
        return {
            "symbol": name, "def_count": len(targets), "defs": [_symbol(t) for t in targets], "caller_count": row["n"], "caller_file_count": row["f"],
            "exact": row["exact"], "ambiguous": row["ambiguous"], "unresolved": row["unresolved"], "unparsed_files_count": self.graph.parse_failures.count(),
        }

    def exists(self, name: str, prefix: bool = False) -> Record:
        defs, names = Q.existing(self.graph, self.spark.createDataFrame([(name,)], "wanted string"), prefix)
        found = _rows(defs.orderBy("file", "start_line", "end_line", "id"))
        return {
            "name": name,
            "defs": [{"fq_name": d["fq_name"], "kind": d["kind"], "file": d["file"], "span": _span(d), "signature": d["signature"], "docstring": d["docstring"]} for d in found],
            "import_names_matches": _rows(names.select("file", "source_module").distinct().orderBy("file", "source_module")),
        }

    def surface(self, module: str) -> Record:
        graph = self.graph
        files = Q.surface_files(graph, self.spark.createDataFrame([(module,)], "module string"))
        file = files.first()["file"]
        top, methods, imports = (_rows(t) for t in Q.surface(graph, files))

        def shown(d: Record) -> Record:
            return {"name": d["name"], "kind": d["kind"], "span": _span(d), "signature": d["signature"], "docstring": d["docstring"]}

        def inside(d: Record) -> list[Record]:
            mine = [m for m in methods if m["class_name"] == d["name"] and m["class_line"] == d["start_line"]] if d["kind"] == "class" else []
            return [shown(m) for m in sorted(mine, key=lambda m: m["start_line"])]

        return {
            "module": module, "defs": [shown(d) | {"methods": inside(d)} for d in sorted(top, key=lambda d: d["start_line"])],
            "imports": [i["raw"] for i in sorted(imports, key=lambda i: i["line"])], "unparsed": file in self.parse_failures(),
        }

    def impact(self, changed: dict[str, list[tuple[int, int]]], deleted: list[str]) -> Record:
        """Definitions that changed lines touch, and those of deleted files as last stored, with their callers."""
        gone = self.graph.symbols.where(F.col("file").isin(deleted)) if deleted else None
        lost = gone.collect() if gone is not None else []
        kind = self.graph.symbols.schema
        self.refresh()
        symbols, edges = self.graph.symbols, self.edges
        ranges = self.spark.createDataFrame([(f, a, b) for f, rs in changed.items() for a, b in rs], "file string, range_start bigint, range_end bigint")
        hit = I.changed_symbols(symbols, ranges)
        parts = [I.impact(hit, "changed", edges), I.impact(self.spark.createDataFrame(lost, kind), "deleted", edges)]
        callers: dict[str, list[Record]] = {}
        for t in (hit, self.spark.createDataFrame(lost, kind)):
            for c in _rows(I.impact_callers(t, edges, symbols).orderBy("name", "place")):
                mine = callers.setdefault(c["name"], [])
                if c["place"] > len(mine):
                    mine.append({k: c[k] for k in ("caller", "file", "line", "resolution")})
        entries = [r for p in parts for r in _rows(p.orderBy("file", "start_line"))]
        return {
            "changed_symbols": [{k: e[k] for k in ("fq_name", "file", "start_line", "end_line", "kind", "status", "caller_count", "caller_files")} | {"callers": callers.get(e["name"], []), "callers_omitted": e["callers_omitted"]} for e in entries],
            "files_no_symbols": [r["file"] for r in I.files_without_symbols(symbols, ranges).orderBy("file").collect()],
        }

    def bundle(self, spec: str, budget: int = 16000, max_callers: int = 20, depth: int = 1, radius: int = 3, tokenizer: Tokenizer | None = None) -> Record:
        """Target, callees, capped callers with snippets, and a report of all that is ambiguous, unresolved or left out."""
        tokenizer = tokenizer or ApproxTokenizer()
        closure = self.closure(spec, depth)
        if not closure["targets"]:
            raise LookupError(f"symbol not found: no definition named {spec!r}")
        graph, name, t = self.graph, closure["symbol"], closure["targets"][0]
        text = graph.files.where(F.col("path") == t["file"]).select("content").first()
        lines = ((text["content"] if text else None) or "").splitlines()
        ranked = B.ranked_callers(self.edges.where(F.col("callee_name") == name), graph.symbols)
        every = _rows(ranked.orderBy("place"))
        shown = _rows(B.with_snippets(ranked, graph.symbols, graph.files, radius).where(F.col("place") <= max_callers).orderBy("place"))
        many = len(closure["targets"]) > 1
        labelled = lambda label: [c["name"] for c in closure["callees"] if c["resolution"] == label]
        unparsed = self.parse_failures()
        out = {
            "target": {k: t[k] for k in ("fq_name", "file", "start_line", "end_line", "signature", "docstring")} | {"body": "\n".join(lines[t["start_line"] - 1 : t["end_line"]])},
            "callees": [{k: c[k] for k in ("name", "resolution", "file", "signature", "docstring")} for c in closure["callees"]],
            "callers": [{"caller": c["caller"], "resolution": c["resolution"], "is_test": c["is_test"], "call_site": {"file": c["file"], "line": c["line"], "snippet": c["snippet"]}} for c in shown],
            "report": {
                "token_count": 0, "budget": budget, "over_budget": False, "caller_count": len(every), "callers_included": len(shown), "test_caller_count": sum(c["is_test"] for c in every),
                "omitted": [f"{c['file']}:{c['line']}" for c in every[max_callers:]], "ambiguous": labelled("ambiguous") + ([f"<target:{spec}>"] if many else []),
                "unresolved": labelled("unresolved"), "unparsed_files": unparsed[:10], "unparsed_files_count": len(unparsed),
            },
            "meta": {"depth": depth, "tokenizer": tokenizer.name, "ambiguous_target": many},
        }
        out["report"]["token_count"] = tokenizer.count(json.dumps(out, ensure_ascii=False, separators=(",", ":")))
        out["report"]["over_budget"] = out["report"]["token_count"] > budget
        return out


def _span(d: Record) -> Record:
    return {"start_line": d["start_line"], "end_line": d["end_line"]}


def _symbol(d: Record) -> Record:
    return {k: d[k] for k in ("fq_name", "name", "file", "start_line", "end_line", "signature", "docstring")}


def seed(spark: SparkSession, target: str | Path, source: str | Path, force: bool = False) -> Record:
    """Start target's store from source's, then refresh it."""
    have = Path(source) / tree.STORE
    if not (have / "meta.json").exists():
        raise ValueError(f"{source} has no index")
    into = Store(spark, target)
    if into.meta and not force:
        raise ValueError(f"{target} has an index already")
    into.drop()
    shutil.copytree(have, into.home, dirs_exist_ok=True, ignore=shutil.ignore_patterns("lock"))
    return Store(spark, target).refresh()


def collect_garbage(root: str | Path, yes: bool) -> str:
    home = Path(root) / tree.STORE
    if not yes:
        raise ValueError(f"deleting {home} must be confirmed with --yes")
    if not home.exists():
        return f"nothing to remove: {home} does not exist"
    shutil.rmtree(home)
    return f"removed {home}"
