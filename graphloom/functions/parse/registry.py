"""A parser for each language."""

from __future__ import annotations

from graphloom.functions.names import LANGUAGES
from graphloom.functions.parse.brace import parse_braces
from graphloom.functions.parse.facts import Facts
from graphloom.functions.parse.python import parse_python

SUSPECT = "suspect: parsed with zero defs/calls/imports for a non-empty file"


def language(path: str) -> str | None:
    """The language of a path's extension; letter case counts."""
    head, dot, ext = path.rpartition("/")[2].rpartition(".")
    return LANGUAGES.get(ext) if dot and head else None


def parse(text: str, lang: str) -> Facts:
    return parse_python(text) if lang == "python" else parse_braces(text, lang)


def extensions() -> str:
    return " ".join(f".{e}" for e in LANGUAGES)
