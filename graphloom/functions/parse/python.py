"""Python sources by the standard library's syntax tree, with a line scanner for what doesn't compile."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

from graphloom.functions.parse.facts import Call, Definition, Facts, preview

MODULE = "<module>"


@dataclass(frozen=True)
class _Scope:
    """enclosing: the function around; owner: the class whose body this is; self_class: what `self` is here."""

    enclosing: str = MODULE
    owner: str | None = None
    self_class: str | None = None


def simple_type(node: ast.expr | None) -> str | None:
    """The class of T, "T", Optional[T], T | None and None | T; of anything else, None."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Constant(value=str(text)) if text.isidentifier():
            return text
        case ast.Subscript(value=ast.Name(id="Optional"), slice=ast.Name(id=name)):
            return name
        case ast.BinOp(left=ast.Name(id=name), op=ast.BitOr(), right=ast.Constant(value=None)):
            return name
        case ast.BinOp(left=ast.Constant(value=None), op=ast.BitOr(), right=ast.Name(id=name)):
            return name
    return None


def _built(node: ast.expr | None) -> str | None:
    """C of a call C(...)."""
    return node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None


def _placed(node: ast.AST) -> Iterator[ast.AST]:
    for child in ast.iter_child_nodes(node):
        if hasattr(child, "lineno"):
            yield child
        else:
            yield from _placed(child)


class _Walk:
    def __init__(self, text: str) -> None:
        self.lines = text.splitlines()
        self.facts = Facts()
        self.bound: list[tuple[str, str, str]] = []  # function, variable, class
        self.attributes: list[tuple[str, str, str]] = []  # class, attribute, class
        self.by_variable: list[tuple[int, str]] = []
        self.by_attribute: list[tuple[int, str, str]] = []

    def head(self, node: ast.AST) -> str:
        line = self.lines[node.lineno - 1].encode() if node.lineno <= len(self.lines) else b""
        return line[node.col_offset :].decode("utf-8", "replace").rstrip()

    def define(self, node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, scope: _Scope, **more: str | None) -> None:
        doc = None
        if node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            doc = preview(node.body[0].value.value.split("\n")[0])
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        self.facts.defs.append(Definition(node.name, kind, scope.owner, node.lineno, node.end_lineno or node.lineno, self.head(node), docstring=doc, **more))

    def visit(self, node: ast.AST, scope: _Scope) -> None:
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                for d in node.decorator_list:
                    self.visit(d, scope)
                self.define(node, scope, ret_class=simple_type(node.returns))
                inner = _Scope(node.name, None, scope.owner or scope.self_class)
                for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                    if cls := simple_type(a.annotation):
                        self.bound.append((node.name, a.arg, cls))
                self.children(node, inner, skip=node.decorator_list)
                return
            case ast.ClassDef():
                for d in node.decorator_list:
                    self.visit(d, scope)
                base = node.bases[0].id if len(node.bases) == 1 and not node.keywords and isinstance(node.bases[0], ast.Name) else None
                self.define(node, scope, base_class=base)
                self.children(node, replace(scope, owner=node.name), skip=node.decorator_list)
                return
            case ast.Assign(targets=[*_, target], value=value) | ast.AnnAssign(target=target, value=value):
                if cls := _built(value):
                    match target:
                        case ast.Name(id=name):
                            self.bound.append((scope.enclosing, name, cls))
                        case ast.Attribute(value=ast.Name(id="self"), attr=attr) if scope.self_class:
                            self.attributes.append((scope.self_class, attr, cls))
            case ast.Call(func=func):
                self.call(node, func, scope)
            case ast.Import():
                self.facts.imports.append((self.head(node), node.lineno))
                self.alias(node.names)
            case ast.ImportFrom():
                if node.module != "__future__":
                    self.facts.imports.append((self.head(node), node.lineno))
                    if node.level == 0 and node.module:
                        self.facts.import_names += [(a.asname or a.name, node.module) for a in node.names if a.name != "*"]
                self.alias(node.names)
        self.children(node, scope)

    def children(self, node: ast.AST, scope: _Scope, skip: list[ast.expr] = ()) -> None:
        left_out = {id(x) for x in skip}
        for child in sorted((c for c in _placed(node) if id(c) not in left_out), key=lambda c: (c.lineno, c.col_offset)):
            self.visit(child, scope)

    def alias(self, names: list[ast.alias]) -> None:
        self.facts.aliases += [(a.asname, a.name.rpartition(".")[2]) for a in names if a.asname]

    def call(self, node: ast.Call, func: ast.expr, scope: _Scope) -> None:
        calls = self.facts.calls
        match func:
            case ast.Name(id=name):
                calls.append(Call(name, "func", node.lineno, scope.enclosing))
            case ast.Attribute(value=on, attr=name):
                calls.append(Call(name, "method", node.lineno, scope.enclosing))
                match on:
                    case ast.Name(id="self"):
                        calls[-1].receiver_class = scope.self_class
                    case ast.Name(id=variable):
                        self.by_variable.append((len(calls) - 1, variable))
                    case ast.Call():
                        calls[-1].receiver_class = _built(on)
                    case ast.Attribute(value=ast.Name(id="self"), attr=attr) if scope.self_class:
                        self.by_attribute.append((len(calls) - 1, scope.self_class, attr))

    def settle(self) -> Facts:
        """Receiver hints of variables and attributes that are bound to one class only."""
        returns: dict[str, str] = {}
        for d in self.facts.defs:
            if d.kind == "function" and d.ret_class:
                returns.setdefault(d.name, d.ret_class)
        variables: dict[tuple[str, str], set[str]] = {}
        for function, variable, cls in self.bound:
            variables.setdefault((function, variable), set()).add(returns.get(cls, cls))
        attributes: dict[tuple[str, str], set[str]] = {}
        for owner, attr, cls in self.attributes:
            attributes.setdefault((owner, attr), set()).add(cls)
        for i, variable in self.by_variable:
            found = variables.get((self.facts.calls[i].enclosing, variable), ())
            if len(found) == 1:
                (self.facts.calls[i].receiver_class,) = found
        for i, owner, attr in self.by_attribute:
            found = attributes.get((owner, attr), ())
            if len(found) == 1:
                (self.facts.calls[i].receiver_class,) = found
        return self.facts


_STRING = re.compile(r"""'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|\#[^\n]*""", re.S)
_DEF = re.compile(r"(?:async\s+)?def\s+(\w+)\s*\(")
_CLASS = re.compile(r"class\s+(\w+)\s*(?:\(\s*(\w*)\s*\))?\s*[(:]")
_CALL = re.compile(r"(\.\s*)?\b([^\W\d]\w*)\s*\(")
_WORDS = frozenset("and as assert async await class def del elif else except exec for from global if import in is lambda not or print raise return while with yield".split())


def scan_lines(text: str) -> Facts:
    """Definitions, calls and imports of a source that doesn't compile, line by line, by indentation."""
    blank = _STRING.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    facts, open_ = Facts(), []  # (indent, definition)
    shown = text.splitlines()
    fresh: Definition | None = None  # the definition whose body begins
    for number, line in enumerate(blank.splitlines(), 1):
        body = line.strip()
        if fresh and (said := shown[number - 1].strip()):
            if not body and (m := re.match(r"[rRuU]?(\"\"\"|\'\'\'|[\"\'])", said)):
                fresh.docstring = preview(said[m.end() :].removesuffix(m[1]))
            fresh = None
        if not body:
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        for _, d in open_:
            d.end_line = number
        functions = [d.name for _, d in open_ if d.kind == "function"]
        owner = open_[-1][1].name if open_ and open_[-1][1].kind == "class" else None
        if m := _DEF.match(body) or _CLASS.match(body):
            kind = "class" if body.startswith("class") else "function"
            d = Definition(m[1], kind, owner, number, number, shown[number - 1].strip(), base_class=(m[2] or None) if kind == "class" else None)
            facts.defs.append(d)
            open_.append((indent, d))
            fresh = d
            body = body[m.end() - 1 :]
            functions = [*functions, m[1]] if kind == "function" else functions
        elif re.match(r"(import|from)\s", body):
            facts.imports.append((shown[number - 1].strip(), number))
            facts.aliases += [(b, a.rpartition(".")[2]) for a, b in re.findall(r"([\w.]+)\s+as\s+(\w+)", body)]
            if (m := re.match(r"from\s+([A-Za-z_][\w.]*)\s+import\s+(.+)", body)) and "*" not in m[2]:
                facts.import_names += [(b or a, m[1]) for a, b in re.findall(r"(\w+)(?:\s+as\s+(\w+))?", m[2])]
            continue
        for m in _CALL.finditer(body):
            if m[2] not in _WORDS:
                own = next((d.name for _, d in reversed(open_) if d.kind == "class"), None) if m[1] and functions and re.search(r"(?<![\w.])self\s*$", body[: m.start()]) else None
                facts.calls.append(Call(m[2], "method" if m[1] else "func", number, functions[-1] if functions else MODULE, own))
    return facts


def parse_python(text: str) -> Facts:
    walk = _Walk(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        for node in tree.body:
            walk.visit(node, _Scope())
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return scan_lines(text)
    return walk.settle()
