"""Source trees: listed on the driver, read and parsed on executors.

Spark's file sources hide names that begin with _ or a dot, so listing is our own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions.parse.registry import SUSPECT, language, parse
from graphloom.schema import Graph

STORE = ".graphloom"
SKIPPED = frozenset((".git", STORE, "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "target", ".mypy_cache", "vendor"))

_DEFS = "array<struct<name string, kind string, parent_class string, start_line bigint, end_line bigint, signature string, ret_class string, base_class string, docstring string>>"
_CALLS = "array<struct<name string, call_kind string, line bigint, enclosing string, receiver_class string>>"
#: One row a file, with all it holds.
PARSED = (
    f"path string, lang string, hash string, content string, error string, defs {_DEFS}, calls {_CALLS}, imports array<struct<raw string, line bigint>>, "
    "aliases array<struct<local string, source string>>, import_names array<struct<local string, source_module string>>"
)


def list_sources(root: Path) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths of registered files, sorted, (unreadable folder, reason)); linked folders are followed once."""
    paths: list[str] = []
    failed: list[tuple[str, str]] = []
    seen: set[tuple[int, int]] = set()

    def fail(e: OSError) -> None:
        failed.append((os.path.relpath(e.filename, root) + "/", f"unreadable: {e.strerror}"))

    for folder, inside, files in os.walk(root, followlinks=True, onerror=fail):
        state = os.stat(folder)
        if (state.st_dev, state.st_ino) in seen:
            inside[:] = []
            continue
        seen.add((state.st_dev, state.st_ino))
        inside[:] = sorted(d for d in inside if d not in SKIPPED)
        at = os.path.relpath(folder, root)
        paths += [f if at == "." else f"{at}/{f}" for f in files if language(f)]
    return sorted(paths), failed


def _table(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, min(len(paths) // 8 + 1, 4 * spark.sparkContext.defaultParallelism)))


def hashes(spark: SparkSession, root: Path, paths: list[str]) -> DataFrame:
    """(path, hash) of what is on disk; null where a file can't be read."""
    base = str(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_read(base, p)[1] for p in names], pa.string())], names=["path", "hash"])

    return _table(spark, paths).mapInArrow(run, "path string, hash string")


def _read(base: str, path: str) -> tuple[bytes, str | None, str | None]:
    """(bytes, hash, error)"""
    try:
        raw = Path(base, path).read_bytes()
    except OSError as e:
        return b"", None, f"unreadable: {e.strerror}"
    return raw, hashlib.sha256(raw).hexdigest(), None


def parsed_row(path: str, raw: bytes, digest: str | None, error: str | None) -> dict:
    """A row of PARSED."""
    row = {"path": path, "lang": language(path), "hash": digest, "error": error, "content": None}
    row |= {n: [] for n in ("defs", "calls", "imports", "aliases", "import_names")}
    if error:
        return row
    try:
        row["content"] = raw.decode()
    except UnicodeDecodeError:
        pass  # lines of such a file read as empty; facts come from a lossy decoding
    text = raw.decode("utf-8", "replace")
    try:
        facts = parse(text, row["lang"])
    except Exception as e:  # a scanner's own failure is reported, and the file kept
        return row | {"error": f"parse error: {type(e).__name__}: {e}"}
    row |= {
        "defs": [vars(d) for d in facts.defs], "calls": [vars(c) for c in facts.calls],
        "imports": [{"raw": a, "line": b} for a, b in facts.imports], "aliases": [{"local": a, "source": b} for a, b in facts.aliases],
        "import_names": [{"local": a, "source_module": b} for a, b in facts.import_names],
    }
    if facts.empty() and text.strip():
        row["error"] = SUSPECT
    return row


def parsed(spark: SparkSession, root: Path, paths: list[str]) -> DataFrame:
    """The files read and parsed, once, as PARSED."""
    base = str(root)
    shape = spark.createDataFrame([], PARSED).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([parsed_row(path, *_read(base, path))], schema=arrow)

    return _table(spark, paths).mapInArrow(run, shape)


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """PARSED of texts by path, without a disk."""
    rows = [parsed_row(p, t.encode(), hashlib.sha256(t.encode()).hexdigest(), None) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, PARSED) if rows else spark.createDataFrame([], PARSED)


def graph_of(table: DataFrame) -> Graph:
    """The base tables of PARSED rows."""

    def each(column: str, *fields: str) -> DataFrame:
        rows = table.select(F.col("path").alias("file"), "lang", F.posexplode(column).alias("seq", "x")).withColumn("seq", F.col("seq").cast("bigint"))
        return rows.select("file", "seq", *(F.col(f"x.{f}") for f in fields), "lang")

    symbols = each("defs", "name", "kind", "parent_class", "start_line", "end_line", "signature", "ret_class", "base_class", "docstring")
    return Graph(
        files=table.where("hash is not null").select("path", "hash", "lang", "content"),
        symbols=symbols.select(F.xxhash64("file", "seq").alias("id"), *symbols.columns),
        imports=each("imports", "raw", "line").drop("lang"),
        import_names=each("import_names", "local", "source_module").drop("lang"),
        aliases=each("aliases", "local", "source").drop("lang"),
        call_sites=each("calls", "enclosing", "name", "line", "call_kind", "receiver_class"),
        parse_failures=table.where("error is not null").select(F.col("path").alias("file"), "error"),
    )
