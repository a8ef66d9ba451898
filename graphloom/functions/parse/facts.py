"""What a parser finds in a file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Definition:
    name: str
    kind: str
    parent_class: str | None
    start_line: int
    end_line: int
    signature: str
    ret_class: str | None = None
    base_class: str | None = None
    docstring: str | None = None


@dataclass
class Call:
    name: str
    call_kind: str
    line: int
    enclosing: str
    receiver_class: str | None = None


@dataclass
class Facts:
    """Each list is in source order; a definition comes before what it holds."""

    defs: list[Definition] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)
    aliases: list[tuple[str, str]] = field(default_factory=list)
    import_names: list[tuple[str, str]] = field(default_factory=list)

    def empty(self) -> bool:
        return not (self.defs or self.calls or self.imports)


def preview(line: str) -> str | None:
    """At most 120 characters of a documentation line; None if it is blank."""
    return line.strip()[:120] or None
