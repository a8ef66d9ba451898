"""Column functions on paths, names and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language.
LANGUAGES: dict[str, str] = {
    "py": "python", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp",
    "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
}
#: Python types that no file of a repository defines.
BUILTINS = (
    "dict", "list", "set", "frozenset", "tuple", "str", "bytes", "bytearray", "int", "float",
    "complex", "bool", "object", "type", "BaseException", "Exception",
)

_EXT = r"\.(" + "|".join(LANGUAGES) + r")$"


def language_of(path: Column) -> Column:
    """The language that a path's extension is registered for, or null; letter case counts."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(path.contains("."), F.try_element_at(table, F.element_at(F.split(path, r"\."), -1)))


def has_source_ext(path: Column) -> Column:
    return path.rlike(_EXT)


def fq_name(file: Column, name: Column, parent: Column) -> Column:
    """Module path without extension and one leading src/, class if any, name, with dots between."""
    module = F.regexp_replace(F.regexp_replace(file, _EXT, ""), "^src/", "")
    return F.concat_ws(".", F.replace(module, F.lit("/"), F.lit(".")), parent, name)


def module_file(module: Column) -> Column:
    """A source path as it is; a dotted path as that of a Python file."""
    return F.when(has_source_ext(module), module).otherwise(dotted_file(module))


def dotted_file(module: Column) -> Column:
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))


def path_matches(path: Column, wanted: Column) -> Column:
    """path is wanted, or ends with it after a slash; literal and with letter case."""
    return (path == wanted) | path.endswith(F.concat(F.lit("/"), wanted))


def path_suffixes(path: Column) -> Column:
    """Every ending of a path that starts a component, the whole first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def is_test_file(path: Column) -> Column:
    """A component is test or tests, or the name is test_*.py or *_test.py."""
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("test"), F.lit("tests"))) | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$")


def lines(content: Column) -> Column:
    """Lines of a text; an empty one after the last line feed doesn't count."""
    parts = F.split(content, "\r?\n")
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def read_span(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1 and inclusive, as far as they exist; empty if none does."""
    text = F.coalesce(content, F.lit(""))
    every = lines(text)
    a = F.least(F.greatest(start, F.lit(1)) - 1, F.size(every))
    b = F.least(F.greatest(end, F.lit(1)), F.size(every))
    return F.when(a >= b, "").otherwise(F.array_join(F.slice(every, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "\n"))


def read_snippet(content: Column, line: Column, radius: int) -> Column:
    return read_span(content, line - radius, line + radius)


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def approx_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")
