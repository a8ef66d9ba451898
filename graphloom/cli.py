"""python -m graphloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom import mcp
from graphloom.functions.parse.registry import extensions, language, parse
from graphloom.render import render_prompt, unparsed_line
from graphloom.sources import git
from graphloom.store import Store, collect_garbage, seed


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="Code-symbol graph on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, where: str = "repo") -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.add_argument(where)
        return p

    add("parse", "what one file defines, calls and imports", "path")
    add("index", "read a whole tree")
    add("status", "counts of the stored graph, without reading the tree")
    for name, about in (("closure", "definitions, callers, callees"), ("enumerate", "counts of callers and definitions"), ("bundle", "context for a change")):
        p = add(name, about)
        p.add_argument("--symbol", required=True)
        if name != "enumerate":
            p.add_argument("--depth", type=int, default=1)
    p.add_argument("--budget", type=int, default=16000)
    p.add_argument("--max-callers", type=int, default=20)
    p.add_argument("--snippet-radius", type=int, default=3)
    p.add_argument("--tokenizer", default="approx", choices=["approx"])
    p.add_argument("--format", default="json", choices=["json", "prompt"])
    p = add("exists", "whether a name is taken")
    p.add_argument("--name", required=True)
    p.add_argument("--prefix", action="store_true")
    add("surface", "what a module offers").add_argument("--module", required=True)
    p = add("seed", "start from another tree's index")
    p.add_argument("--from", dest="source", required=True)
    p.add_argument("--force", action="store_true")
    p = add("impact", "what a diff touches")
    p.add_argument("--diff")
    p.add_argument("--staged", action="store_true")
    add("mcp", "serve over MCP on standard input and output")
    add("gc", "delete the index").add_argument("--yes", action="store_true")
    return top


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _fresh(store: Store) -> Store:
    r = store.refresh()
    if r["changed"] + r["deleted"]:
        print(f"refreshed: {r['changed']} changed, {r['deleted']} deleted, {r['relabeled']} edges relabeled", file=sys.stderr)
    return store


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> str:
    """What a command prints."""
    pretty = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    if args.command == "parse":
        lang = language(args.path)
        if lang is None:
            raise ValueError(f"unsupported language for {args.path}; supported: {extensions()}")
        return pretty(asdict(parse(Path(args.path).read_text(encoding="utf-8"), lang)))
    if args.command == "gc":
        return collect_garbage(args.repo, args.yes)
    if args.command == "impact":
        changed, deleted = git.parse_diff(git.diff(Path(args.repo), args.diff, args.staged))
    spark = spark or _spark()
    if args.command == "seed":
        r = seed(spark, args.repo, args.source, args.force)
        return f"seeded {args.repo} from {args.source}: {r['changed']} changed, {r['deleted']} deleted, {r['relabeled']} edges relabeled"
    store = Store(spark, args.repo)
    counts = "{files} files, {symbols} symbols, {imports} imports, {edges} edges (exact {exact}, ambiguous {ambiguous}, unresolved {unresolved})"
    match args.command:
        case "index":
            return "indexed: " + counts.format(**store.index()) + f" -> {store.home}"
        case "status":
            failed = store.parse_failures()
            return "\n".join(filter(None, ["store: " + counts.format(**store.status()), unparsed_line(len(failed), failed)]))
        case "closure":
            return pretty(_fresh(store).closure(args.symbol, args.depth))
        case "enumerate":
            return pretty(_fresh(store).enumerate(args.symbol))
        case "exists":
            return pretty(_fresh(store).exists(args.name, args.prefix))
        case "surface":
            return pretty(_fresh(store).surface(args.module))
        case "bundle":
            b = _fresh(store).bundle(args.symbol, args.budget, args.max_callers, args.depth, args.snippet_radius)
            return render_prompt(b) if args.format == "prompt" else pretty(b)
        case "impact":
            return pretty(store.impact(changed, deleted))
        case "mcp":
            mcp.serve(store, sys.stdin, sys.stdout)
    return ""


def main(argv: list[str] | None = None) -> int:
    try:
        if text := run(_arguments().parse_args(argv)):
            print(text)
    except (ValueError, LookupError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
