"""Tables of a code-symbol graph."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in columns.items()])


#: seq orders the rows of a file as its source does; ids follow from (file, seq).
SCHEMAS: dict[str, T.StructType] = {
    "files": _table(path="string", hash="string", lang="string", content="string"),
    "symbols": _table(
        id="bigint", file="string", seq="bigint", name="string", kind="string", parent_class="string", start_line="bigint",
        end_line="bigint", signature="string", ret_class="string", base_class="string", docstring="string", lang="string",
    ),
    "imports": _table(file="string", seq="bigint", raw="string", line="bigint"),
    "import_names": _table(file="string", seq="bigint", local="string", source_module="string"),
    "aliases": _table(file="string", seq="bigint", local="string", source="string"),
    "call_sites": _table(
        file="string", seq="bigint", lang="string", enclosing="string", name="string", line="bigint", call_kind="string", receiver_class="string",
    ),
    "parse_failures": _table(file="string", error="string"),
}

LABELS = ("exact", "ambiguous", "unresolved")


@dataclass(frozen=True)
class Graph:
    """Base tables; edges are a function of them."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    import_names: DataFrame
    aliases: DataFrame
    call_sites: DataFrame
    parse_failures: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, change) -> Graph:
        """A graph of change(name, table) for each table."""
        return Graph(**{n: change(n, t) for n, t in self.tables().items()})
