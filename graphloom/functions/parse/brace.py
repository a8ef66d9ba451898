"""Shallow scanners for languages with braces.

Comments and literals are blanked, the rest is cut into tokens, and one walk over them finds
declarations by their shape and calls by a name before an opening bracket. What the shapes don't cover
is passed over, never guessed: a missed call is missing, a wrong one isn't made up.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, replace

from graphloom.functions.parse.facts import Call, Definition, Facts, preview

MODULE = "<module>"
_TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|->|=>|::|\?\.|\.\.\.|\"[^\"\n]*\"|\S")
_C = "if else for while do switch case return sizeof alignof goto default struct enum union typedef static const volatile extern inline register"
_CPP = _C + " new delete throw catch try decltype typeid noexcept static_assert class namespace template using operator this static_cast dynamic_cast const_cast reinterpret_cast alignas explicit virtual"
_MANAGED = "if else for while do switch case return throw catch try finally new this super base class interface enum record struct"
_SCRIPT = "if else for while do switch case return throw catch try finally new this super function class typeof instanceof in of void delete yield await import export extends let const var"
#: Words that are no names.
_CONTROL: dict[str, frozenset[str]] = {
    "c": frozenset(_C.split()),
    "cpp": frozenset(_CPP.split()),
    "java": frozenset((_MANAGED + " synchronized assert instanceof import package extends implements yield").split()),
    "csharp": frozenset((_MANAGED + " foreach lock using fixed checked unchecked sizeof typeof nameof default is as in out ref when where await yield namespace stackalloc").split()),
    "javascript": frozenset(_SCRIPT.split()),
    "typescript": frozenset((_SCRIPT + " interface").split()),
    "go": frozenset("if else for switch case select func return go defer range chan map struct interface type var const package import goto default fallthrough break continue".split()),
    "rust": frozenset("if else for while loop match return fn struct enum trait union impl use mod let mut ref move unsafe async await pub crate super self Self in as where dyn const static extern type".split()),
}
_RETURNS = "return else case in throw do default"
#: A name after one of these begins an expression; after another name it is being declared.
_BEFORE_CALL: dict[str, frozenset[str]] = {
    "c": frozenset("return else case do goto default sizeof".split()),
    "cpp": frozenset("return else case do goto default throw co_return co_await co_yield".split()),
    "java": frozenset((_RETURNS + " yield assert instanceof").split()),
    "csharp": frozenset((_RETURNS + " await yield is as when out ref").split()),
    "javascript": frozenset((_RETURNS + " of await yield typeof instanceof void delete extends").split()),
    "typescript": frozenset((_RETURNS + " of await yield typeof instanceof void delete extends as is keyof").split()),
    "go": frozenset("return else case go defer range default if for switch select in".split()),
    "rust": frozenset("return else in match if while as await mut ref move unsafe loop box break".split()),
}


@dataclass(frozen=True)
class _Comment:
    start: int
    end: int
    text: str


@dataclass(frozen=True)
class _Scope:
    enclosing: str = MODULE
    container: str | None = None  # the class whose body this is
    self_class: str | None = None  # Rust: what `self` is; Go: the receiver's type
    receiver: str | None = None  # Go: the receiver's name


def _literals(lang: str) -> re.Pattern[str]:
    comment = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    plain = r'"(?:\\.|[^"\\\n])*"'
    extra = {
        "rust": r"""|b?r(#+)".*?"\1|b?r"[^"]*"|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\\n])'""",
        "go": r"|`[^`]*`|" + plain + r"|'(?:\\.|[^'\\\n])+'",
        "csharp": r'|@"(?:""|[^"])*"|\$@"(?:""|[^"])*"|"""' + r'.*?"""|' + plain + r"|'(?:\\.|[^'\\\n])+'",
        "java": r'|""".*?"""|' + plain + r"|'(?:\\.|[^'\\\n])+'",
    }.get(lang, r"|" + plain + r"|'(?:\\.|[^'\\\n])*'")
    return re.compile(comment + extra, re.S)


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


class _Source:
    """A text without literals and comments, as tokens with matched brackets."""

    def __init__(self, text: str, lang: str) -> None:
        self.text, self.comments = text, []
        self.directives: list[tuple[str, int]] = []
        shown = self._script(text) if lang in ("javascript", "typescript") else _literals(lang).sub(self._literal, text)
        if lang in ("c", "cpp", "csharp"):
            shown = re.sub(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", self._directive, shown, flags=re.M)
        self.tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(shown)]
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.line_starts = starts
        self.close: dict[int, int] = {}
        open_: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for i, (t, _, _) in enumerate(self.tokens):
            if t in "([{" and len(t) == 1:
                open_.append(i)
            elif t in pairs:
                while open_ and self.tokens[open_[-1]][0] != pairs[t] and t == "}":
                    open_.pop()  # an unclosed bracket within a block
                if open_ and self.tokens[open_[-1]][0] == pairs[t]:
                    self.close[open_.pop()] = i

    def _literal(self, m: re.Match[str]) -> str:
        if m[0].startswith(("//", "/*")):
            self.comments.append(_Comment(m.start(), m.end(), m[0]))
            return _blank(m[0])
        inner = "".join("\n" if c == "\n" else " " for c in m[0])
        return '"' + inner[1:-1] + '"' if len(m[0]) > 1 and "\n" not in m[0] else inner

    def _directive(self, m: re.Match[str]) -> str:
        line = self.text[m.start() : m.end()]
        if line.lstrip().startswith("#include"):
            at = m.start() + len(line) - len(line.lstrip())
            self.directives.append((line.strip().split("\n")[0].rstrip(), self.text.count("\n", 0, at) + 1))
        return _blank(m[0])

    def _script(self, text: str) -> str:
        """Strings, templates, regular expressions, comments, and tags and texts of JSX blanked; code within ${...} and {...} stays."""
        out, i, n = list(text), 0, len(text)
        # What is open: a template's or an element's code, with its braces, an element's tag, or its text.
        stack: list[list] = []
        last = ""

        def wipe(a: int, b: int) -> None:
            for k in range(a, b):
                if out[k] != "\n":
                    out[k] = " "

        def template(k: int) -> int:
            start = k
            while k < n:
                if text[k] == "\\":
                    k += 2
                elif text[k] == "`":
                    wipe(start, k + 1)
                    return k + 1
                elif text.startswith("${", k):
                    wipe(start, k + 2)
                    stack.append(["template", 0])
                    return k + 2
                else:
                    k += 1
            wipe(start, n)
            return n

        while i < n:
            c = text[i]
            inside = stack[-1][0] if stack else ""
            if inside == "text" and c not in "<{":
                wipe(i, i + 1)
                i += 1
                continue
            if inside == "text" and text.startswith("</", i):
                end = text.find(">", i) + 1 or n
                wipe(i, end)
                stack.pop()
                i, last = end, ")"
                continue
            if c == "<" and (inside == "text" or self._element(text, i, last, out)):
                wipe(i, i + 1)
                stack.append(["tag"])
                i += 1
                continue
            if inside == "tag" and c in "/>" and (c == ">" or text.startswith("/>", i)):
                stack[-1] = ["text"]
                if c == "/":
                    stack.pop()
                    last = ")"
                wipe(i, i + 1 + (c == "/"))
                i += 1 + (c == "/")
                continue
            if inside in ("tag", "text") and c == "{":
                stack.append(["code", 0])
                i, last = i + 1, "{"
                continue
            if inside == "tag" and c not in "\"'":
                wipe(i, i + 1)
                i += 1
                continue
            if text.startswith(("//", "/*"), i):
                end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i + 2) + 2
                end = n if end < (i + 2 if text[i + 1] == "*" else 0) else end
                self.comments.append(_Comment(i, end, text[i:end]))
                wipe(i, end)
                i = end
                continue
            if c in "\"'" and (m := re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'").match(text, i)):
                wipe(i + 1, m.end() - 1)
                out[i] = out[m.end() - 1] = '"'
                i, last = m.end(), '"'
                continue
            if c == "`":
                i, last = template(i + 1), '"'
                out[i - 1] = out[i - 1] if out[i - 1] == "\n" else " "
                continue
            if c == "/" and (not last or last in "(,=:[!&|?{};+-*%<>~^" or re.search(r"\b(return|typeof|case|in|of)\s*$", "".join(out[max(0, i - 12) : i]))):
                if m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(text, i):
                    wipe(i, m.end())
                    i, last = m.end(), '"'
                    continue
            if inside in ("template", "code") and c == "{":
                stack[-1][1] += 1
            elif inside in ("template", "code") and c == "}":
                if stack[-1][1] == 0:
                    stack.pop()
                    i, last = template(i + 1) if inside == "template" else i + 1, '"'
                    continue
                stack[-1][1] -= 1
            if not c.isspace():
                last = c
            i += 1
        return "".join(out)

    @staticmethod
    def _element(text: str, i: int, last: str, out: list[str]) -> bool:
        """Whether < at i opens an element: where a value may begin, and with an end in sight, unlike type parameters and casts."""
        if last and last not in "(,=:[!&|?{};>" and not re.search(r"\b(return|default|case)\s*$", "".join(out[max(0, i - 12) : i])):
            return False
        m = re.compile(r"<(?:([A-Za-z_$][\w.$:-]*)(?=[\s/>])|(?=>))").match(text, i)
        if not m or (last == ">" and "".join(out[:i]).rstrip()[-2:] != "=>"):
            return False
        name = m[1] or ""
        return text.find(f"</{name}", i) >= 0 or bool(name and re.compile(r"[^<>]*/>").match(text, m.end()))


class Scanner:
    def __init__(self, text: str, lang: str) -> None:
        self.lang = lang
        self.s = _Source(text, lang)
        self.t = [x[0] for x in self.s.tokens]
        self.facts = Facts(imports=list(self.s.directives))

    # Places -------------------------------------------------------------------------------------

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def name(self, i: int) -> str | None:
        x = self.at(i)
        return x if x and (x[0].isalpha() or x[0] in "_$") and x not in _CONTROL[self.lang] else None

    def line(self, offset: int) -> int:
        return bisect_right(self.s.line_starts, offset)

    def shut(self, i: int) -> int:
        """The token that closes the bracket at i; the last token if none does."""
        return self.s.close.get(i, len(self.t) - 1)

    def raw(self, i: int, j: int) -> str:
        """First line of the text of tokens i to j."""
        a, b = self.s.tokens[i][1], self.s.tokens[min(j, len(self.t) - 1)][2]
        return self.s.text[a:b].split("\n")[0].rstrip()

    def define(self, name: str, kind: str, parent: str | None, start: int, end: int, doc: bool = False) -> None:
        a, b = self.s.tokens[start][1], self.s.tokens[min(end, len(self.t) - 1)][2]
        self.facts.defs.append(Definition(name, kind, parent, self.line(a), self.line(max(a, b - 1)), self.raw(start, end), docstring=self.doc(start) if doc else None))

    def doc(self, start: int) -> str | None:
        """First line of the documentation comment right before a token."""
        begin = self.s.tokens[start][1]
        floor = self.s.tokens[start - 1][2] if start else 0
        run = [c for c in self.s.comments if floor <= c.start and c.end <= begin]
        if not run:
            return None
        first = run[-1]
        for c in reversed(run[:-1]):
            if self.line(c.end - 1) + 1 < self.line(first.start):
                break
            first = c
        if not first.text.startswith(("///", "/**")):
            return None
        for line in first.text.split("\n"):
            if shown := preview(re.sub(r"(\*/)+$", "", line.strip().lstrip("/").lstrip("*")).strip()):
                return shown
        return None

    def call(self, name: str, kind: str, i: int, scope: _Scope, receiver: str | None = None) -> None:
        self.facts.calls.append(Call(name, kind, self.line(self.s.tokens[i][1]), scope.enclosing, receiver))

    def start_of(self, i: int, low: int) -> int:
        """First token of the declaration that token i is in."""
        while i > low and self.at(i - 1) not in (";", "{", "}") and not (self.at(i - 1) == ":" and self.at(i - 2) in ("public", "private", "protected", "signals")):
            if self.at(i - 1) in (")", "]"):
                back = next((k for k, v in self.s.close.items() if v == i - 1), i - 1)
                i = min(back, i - 1)
            else:
                i -= 1
        return i

    def body_after(self, i: int, stop: str = ";") -> int:
        """The { that begins a body after a header's closing bracket, or -1 where the header ends without one."""
        while i < len(self.t):
            x = self.at(i)
            if x == "{":
                return i
            if x in stop or x in (")", "]", "}"):
                return -1
            i = self.shut(i) + 1 if x in ("(", "[") else i + 1
        return -1

    # Walk ---------------------------------------------------------------------------------------

    def run(self) -> Facts:
        self.walk(0, len(self.t), _Scope())
        return self.facts

    def walk(self, i: int, end: int, scope: _Scope) -> None:
        declare = getattr(self, f"declare_{ {'c': 'c', 'cpp': 'c', 'csharp': 'managed', 'java': 'managed', 'typescript': 'script', 'javascript': 'script'}.get(self.lang, self.lang)}")
        low = i
        while i < end:
            after = declare(i, low, end, scope)
            if after is not None:
                i = after
                continue
            if self.at(i + 1) == "(" and self.name(i):
                self.see_call(i, scope)
            i += 1

    def see_call(self, i: int, scope: _Scope) -> None:
        before, name = self.at(i - 1), self.t[i]
        member = before in (".", "->") or (before == "?." and self.lang in ("javascript", "typescript"))
        if member:
            kind = "func" if self.lang == "c" else "method"
            receiver = None
            on, further = self.at(i - 2), self.at(i - 3)
            if self.lang == "rust" and on == "self" and further not in (".", "::"):
                receiver = scope.self_class
            if self.lang == "go" and on == scope.receiver and further != ".":
                receiver = scope.self_class
            self.call(name, kind, self.chain_start(i), scope, receiver)
        elif before == "::":
            if self.lang in ("rust", "cpp"):
                self.call(name, "method", self.chain_start(i), scope)
        elif before == "?.":
            return
        elif before in ("new", "@", "#", "~"):
            return
        elif before and (before[0].isalpha() or before[0] == "_") and before not in _BEFORE_CALL[self.lang]:
            return  # a declaration: type and name
        elif before in ("*", "&", ">", "]") and self.lang in ("c", "cpp", "csharp", "java") and (scope.enclosing == MODULE or before in (">", "]")):
            return
        elif self.lang == "rust" and self.at(self.shut(i + 1) + 1) in ("=>", "|") and self.at(self.shut(i + 1) + 1) == "=>":
            return  # a pattern
        else:
            self.call(name, "func", i, scope)

    def chain_start(self, i: int) -> int:
        """First token of a.b(c).name: calls are placed where their expression begins."""
        while self.at(i - 1) in (".", "->", "::", "?."):
            i -= 2
            while self.at(i) in (")", "]"):
                back = next((k for k, v in self.s.close.items() if v == i), i)
                i = back - 1 if self.name(back - 1) or self.at(back - 1) in (")", "]", "this", "self") else back
                if i == back:
                    break
        return max(i, 0)

    # Rust ---------------------------------------------------------------------------------------

    def declare_rust(self, i: int, low: int, end: int, scope: _Scope) -> int | None:
        x = self.at(i)
        if x == "#" and self.at(i + 1) in ("[", "!"):
            return self.shut(i + 1 if self.at(i + 1) == "[" else i + 2) + 1
        if x == "fn" and self.name(i + 1):
            start = i
            while start > low and (self.at(start - 1) in ("pub", "async", "unsafe", "const", "extern", "default") or (self.at(start - 1) == ")" and self.at(start - 4) == "pub")):
                start -= 4 if self.at(start - 1) == ")" else 1
            body = self.body_after(i + 2)
            if body < 0:
                while i < end and self.at(i) != ";":
                    i = self.shut(i) + 1 if self.at(i) in ("(", "[") else i + 1
                return i + 1
            self.define(self.t[i + 1], "function", scope.container, start, self.shut(body), doc=True)
            self.walk(body + 1, self.shut(body), _Scope(self.t[i + 1], None, scope.container or scope.self_class))
            return self.shut(body) + 1
        if x in ("struct", "enum", "trait", "union") and self.name(i + 1) and self.at(i + 2) in ("{", "(", ";", "<", ":", "where"):
            start = i
            while start > low and (self.at(start - 1) in ("pub", "unsafe") or (self.at(start - 1) == ")" and self.at(start - 4) == "pub")):
                start -= 4 if self.at(start - 1) == ")" else 1
            body = self.body_after(i + 2)
            stop = self.shut(body) if body >= 0 else next((k for k in range(i, end) if self.at(k) == ";"), end - 1)
            self.define(self.t[i + 1], "class", scope.container, start, stop, doc=True)
            if x == "trait" and body >= 0:
                self.walk(body + 1, stop, replace(scope, container=self.t[i + 1]))
            return stop + 1
        if x == "impl" and (body := self.body_after(i + 1)) >= 0:
            words, depth, k = [], 0, i + 1
            while k < body and self.at(k) != "where":
                depth += {"<": 1, ">": -1}.get(self.at(k), 0)
                if depth == 0 and self.at(k) not in (">",):
                    words.append(self.at(k))
                k += 1
            if "for" in words:
                words = words[len(words) - words[::-1].index("for") :]
            plain = len(words) == 1 and self.name_text(words[0])
            self.walk(body + 1, self.shut(body), replace(scope, container=words[0]) if plain else scope)
            return self.shut(body) + 1
        if x == "use" or (x == "mod" and self.at(i + 2) == ";"):
            stop = next((k for k in range(i, end) if self.at(k) == ";"), end - 1)
            start = i - 1 if self.at(i - 1) == "pub" else i
            self.facts.imports.append((self.raw(start, stop), self.line(self.s.tokens[start][1])))
            self.facts.aliases += [(self.t[k + 1], self.t[k - 1]) for k in range(i, stop) if self.at(k) == "as" and self.name_text(self.at(k + 1))]
            return stop + 1
        if self.name(i) and self.at(i + 1) == "!" and self.at(i + 2) in ("(", "[", "{"):
            return self.shut(i + 2) + 1  # a macro's tokens aren't parsed
        return None

    @staticmethod
    def name_text(x: str) -> bool:
        return bool(x) and (x[0].isalpha() or x[0] == "_")

    # Go -----------------------------------------------------------------------------------------

    def declare_go(self, i: int, low: int, end: int, scope: _Scope) -> int | None:
        x = self.at(i)
        if x == "func":
            k, receiver, owner = i + 1, None, None
            if self.at(k) == "(" and self.name(self.shut(k) + 1) and self.at(self.shut(k) + 2) in ("(", "["):
                inside = [self.at(j) for j in range(k + 1, self.shut(k))]
                if len(inside) >= 2 and self.name_text(inside[0]):
                    receiver, inside = inside[0], inside[1:]
                if inside and inside[0] == "*":
                    inside = inside[1:]
                owner = inside[0] if len(inside) == 1 and self.name_text(inside[0]) else None
                k = self.shut(k) + 1
            elif not self.name(k):
                return None
            body, j = -1, k + 1
            while j < end:
                if self.at(j) in ("interface", "struct") and self.at(j + 1) == "{":
                    j = self.shut(j + 1) + 1
                elif self.at(j) == "{":
                    body = j
                    break
                elif self.at(j) in ("func", "type", "var", "const", "}") and j > k + 1 and self.line(self.s.tokens[j][1]) > self.line(self.s.tokens[j - 1][1]):
                    break
                else:
                    j = self.shut(j) + 1 if self.at(j) in ("(", "[") else j + 1
            stop = self.shut(body) if body >= 0 else j - 1
            self.define(self.t[k], "function", owner, i, stop)
            if body >= 0:
                inner = _Scope(self.t[k], None, owner, receiver) if k > i + 1 else replace(scope, enclosing=self.t[k])
                self.walk(body + 1, stop, inner)
            return stop + 1
        if x == "type" and (self.name(i + 1) or self.at(i + 1) == "("):
            if self.at(i + 1) == "(":
                k, stop = i + 2, self.shut(i + 1)
                while k < stop:
                    k = self.go_type(k, stop) + 1
                return stop + 1
            return self.go_type(i + 1, end) + 1
        if x == "import":
            if self.at(i + 1) == "(":
                k, stop = i + 2, self.shut(i + 1)
            else:
                k, stop = i + 1, next((k for k in range(i + 1, end) if self.at(k).startswith('"')), end - 1) + 1
            while k < stop:
                alias = k if not self.at(k).startswith('"') else None
                path = k + 1 if alias is not None else k
                if not self.at(path).startswith('"'):
                    break
                self.facts.imports.append((self.raw(k, path), self.line(self.s.tokens[k][1])))
                if alias is not None:
                    a, b = self.s.tokens[path][1:]
                    self.facts.aliases.append((self.t[alias], self.s.text[a + 1 : b - 1].rpartition("/")[2]))
                k = path + 1 if self.at(path + 1) != ";" else path + 2
            return max(stop + (self.at(i + 1) == "("), i + 1)
        return None

    def go_type(self, k: int, end: int) -> int:
        """Define the type named at k; its last token."""
        line, j = self.line(self.s.tokens[k][1]), k + 1
        while j < end and self.at(j) != ";" and (self.line(self.s.tokens[j][1]) == line or self.at(j) == "."):
            j = self.shut(j) if self.at(j) in ("{", "(", "[") else j
            line = self.line(self.s.tokens[min(j, len(self.t) - 1)][1])
            j += 1
        self.define(self.t[k], "class", None, k, j - 1)
        return j - 1

    # C and C++ ----------------------------------------------------------------------------------

    def declare_c(self, i: int, low: int, end: int, scope: _Scope) -> int | None:
        x, cpp = self.at(i), self.lang == "cpp"
        if cpp and x in ("class", "struct") and self.name(i + 1) and self.at(i - 1) not in ("<", ",", "enum"):
            body = self.body_after(i + 2, ";(=)")
            if body >= 0 and self.at(i + 2) in ("{", ":", "final"):
                self.define(self.t[i + 1], "class", scope.container, i, self.shut(body))
                self.walk(body + 1, self.shut(body), replace(scope, container=self.t[i + 1]))
                return self.shut(body) + 1
        if self.name(i) and self.at(i + 1) == "(" and scope.enclosing == MODULE and self.at(i - 1) not in (".", "->", "=", "(", ",", "return"):
            after = self.shut(i + 1) + 1
            k = after
            if cpp:
                while self.at(k) in ("const", "noexcept", "override", "final", "&", "volatile", "mutable") or self.at(k) == "->" or (self.at(k - 1) in ("->", "::") and self.name(k)) or self.at(k) == "::":
                    k = self.shut(k + 1) + 1 if self.at(k) == "noexcept" and self.at(k + 1) == "(" else k + 1
                if self.at(k) == ":":
                    k += 1
                    while self.name(k) and self.at(k + 1) in ("(", "{"):
                        k = self.shut(k + 1) + 1
                        k += self.at(k) == ","
            if self.at(k) == "{":
                body, stop = k, self.shut(k)
                parent, known = scope.container, True
                if self.at(i - 1) == "::":
                    parent = self.at(i - 2) if self.name(i - 2) else None
                    known = parent is not None and cpp
                if self.at(i - 1) == "~" or "operator" in (self.at(i - 1), x):
                    known = False
                if known:
                    self.define(x, "function", parent if cpp else None, self.skip_template(self.start_of(i, low), i), stop)
                    self.walk(body + 1, stop, _Scope(x))
                else:
                    self.walk(body + 1, stop, scope)
                return stop + 1
            if k == after and self.at(k) in (";", ",") and self.at(i - 1) and (self.name_text(self.at(i - 1)) or self.at(i - 1) in ("*", "&", ">")):
                return after  # a declaration
        return None

    def skip_template(self, start: int, i: int) -> int:
        if self.at(start) != "template":
            return start
        depth = 0
        for k in range(start + 1, i):
            depth += {"<": 1, ">": -1}.get(self.at(k), 0)
            if depth == 0:
                return k + 1
        return start

    # C# and Java --------------------------------------------------------------------------------

    def declare_managed(self, i: int, low: int, end: int, scope: _Scope) -> int | None:
        x, java = self.at(i), self.lang == "java"
        kinds = ("class", "interface", "enum", "record") if java else ("class", "interface", "struct", "record")
        if x == "@" and java and self.at(i + 1) != "interface" and self.at(i + 2) == "(" and scope.enclosing == MODULE:
            return self.shut(i + 2) + 1
        if x in kinds and self.name_text(self.at(i + 1)) and self.at(i - 1) not in (".", "where", ":", ","):
            at = i + 1 if not (x == "record" and self.at(i + 1) in ("class", "struct")) else i + 2
            body = self.body_after(at + 1)
            stop = self.shut(body) if body >= 0 else next((k for k in range(at, end) if self.at(k) == ";"), end - 1)
            name = self.t[at]
            self.define(name, "class", scope.container, self.start_of(i, low), stop, doc=True)
            if body >= 0:
                inside = body + 1
                if x == "enum":  # constants come first; their arguments aren't calls
                    inside = next((k + 1 for k in self.top(body + 1, stop) if self.at(k) == ";"), stop)
                self.walk(inside, stop, replace(scope, container=name))
            return stop + 1
        if java and x == "import" and scope.enclosing == MODULE:
            stop = next((k for k in range(i, end) if self.at(k) == ";"), end - 1)
            self.facts.imports.append((self.raw(i, stop), self.line(self.s.tokens[i][1])))
            path = "".join(t for t in self.t[i + 1 : stop] if t != "static")
            if "*" not in path and "." in path:
                module, _, local = path.rpartition(".")
                self.facts.import_names.append((local, module))
            return stop + 1
        if not java and x == "using" and self.at(i + 1) != "(" and scope.enclosing == MODULE and scope.container is None:
            stop = next((k for k in range(i, end) if self.at(k) == ";"), end - 1)
            self.facts.imports.append((self.raw(i, stop), self.line(self.s.tokens[i][1])))
            if self.at(i + 2) == "=" and self.name_text(self.at(stop - 1)):
                self.facts.aliases.append((self.t[i + 1], self.t[stop - 1]))
            return stop + 1
        if not (self.name(i) and self.at(i + 1) in ("(", "<")):
            return None
        params = i + 1
        if self.at(params) == "<":
            depth, params = 0, i + 1
            while params < end and not (depth == 0 and params > i + 1):
                depth += {"<": 1, ">": -1}.get(self.at(params), 0)
                params += 1
            if self.at(params) != "(" or java:
                return None
        typed = self.name_text(self.at(i - 1)) and self.at(i - 1) not in _BEFORE_CALL[self.lang] | {"new"} or self.at(i - 1) in (">", "]", "?")
        after = self.shut(params) + 1
        if scope.enclosing == MODULE and scope.container is not None:
            if self.in_value(i, low):
                return None
            built = x == scope.container
            if not (typed or built) or self.at(i - 1) in (".", "@", "new"):
                return None
            return self.method(i, after, low, end, scope, scope.container, True)
        if not java and typed and self.at(i - 1) != "." and scope.enclosing != MODULE and self.at(after) in ("{", "=>"):
            return self.method(i, after, low, end, scope, None, False)
        return None

    def in_value(self, i: int, low: int) -> bool:
        """Whether token i stands after = or => within its member."""
        k = i - 1
        while k >= low and self.at(k) not in (";", "{", "}"):
            if self.at(k) in ("=", "=>"):
                return True
            if self.at(k) in (")", "]"):
                k = next((a for a, b in self.s.close.items() if b == k), k)
            k -= 1
        return False

    def method(self, i: int, after: int, low: int, end: int, scope: _Scope, parent: str | None, doc: bool) -> int:
        name, k = self.t[i], after
        while k < end and self.at(k) not in ("{", ";", "=>"):
            k = self.shut(k) + 1 if self.at(k) in ("(", "[") else k + 1
        stop = self.shut(k) if self.at(k) == "{" else next((j for j in self.top(k, end) if self.at(j) == ";"), end - 1)
        self.define(name, "function", parent, self.start_of(i, low), stop, doc=doc)
        if self.at(k) in ("{", "=>"):
            self.walk(k + 1, stop, _Scope(name))
        return stop + 1

    def top(self, i: int, end: int):
        """Tokens from i on outside inner brackets."""
        while i < end:
            yield i
            i = self.shut(i) + 1 if self.at(i) in ("(", "[", "{") else i + 1

    # JavaScript and TypeScript --------------------------------------------------------------------

    def declare_script(self, i: int, low: int, end: int, scope: _Scope) -> int | None:
        x = self.at(i)
        if x == "function" and (self.name(i + 1) or self.at(i + 1) == "*") and self.at(i - 1) not in ("=", "(", ",", ":", "?", "return"):
            at = i + 2 if self.at(i + 1) == "*" else i + 1
            body = self.body_after(at + 1)
            start = i - 1 if self.at(i - 1) == "async" else i
            if body >= 0 and self.name(at):
                self.define(self.t[at], "function", None, start, self.shut(body), doc=True)
                self.walk(at + 1, body, _Scope(self.t[at]))
                self.walk(body + 1, self.shut(body), _Scope(self.t[at]))
                return self.shut(body) + 1
            return at + 1
        if x == "class" and self.name(i + 1) and self.at(i - 1) not in ("=", "(", ",", ":", "return"):
            body = self.body_after(i + 2)
            if body >= 0:
                start = i - 1 if self.at(i - 1) == "abstract" else i
                self.define(self.t[i + 1], "class", scope.container, start, self.shut(body), doc=True)
                self.members(body + 1, self.shut(body), replace(scope, container=self.t[i + 1]))
                return self.shut(body) + 1
        if self.lang == "typescript" and x in ("interface", "type") and self.name(i + 1):
            if x == "interface":
                body = self.body_after(i + 2)
                return self.shut(body) + 1 if body >= 0 else i + 2
            if self.at(i + 2) in ("=", "<"):
                line = i + 3
                while line < end and self.at(line) != ";" and not (self.line(self.s.tokens[line][1]) > self.line(self.s.tokens[line - 1][2] - 1) and self.at(line) not in ("|", "&", ".", "?", ":")):
                    line = self.shut(line) + 1 if self.at(line) in ("(", "[", "{") else line + 1
                return line
        if x == "import" and self.at(i + 1) not in ("(", "."):
            return self.script_import(i, end)
        if x in ("const", "let", "var") and self.name(i + 1):
            if (value := self.assigned(i + 1, end)) is not None:
                return self.bound_function(i + 1, value, end)
            return None
        if self.name(i) and self.at(i + 1) == "(" and self.at(i - 1) in ("{", ",") and self.at(self.shut(i + 1) + 1) == "{":
            body = self.shut(i + 1) + 1  # a method of an object literal
            self.define(x, "function", scope.container, i, self.shut(body), doc=True)
            self.walk(body + 1, self.shut(body), _Scope(x))
            return self.shut(body) + 1
        return None

    def members(self, i: int, end: int, scope: _Scope) -> None:
        """A class body: methods are definitions, values of fields are walked."""
        low = i
        while i < end:
            if self.name(i) and self.at(i + 1) in ("(", "<") and self.at(i - 1) not in (".", "#", "=", "@", "new"):
                open_ = i + 1
                if self.at(open_) == "<":
                    open_ = next((k for k in range(i, end) if self.at(k) == "("), end)
                body = self.body_after(self.shut(open_) + 1, ";}")
                if body >= 0 and self.line(self.s.tokens[body][1]) <= self.line(self.s.tokens[min(self.shut(open_), len(self.t) - 1)][1]) + 3:
                    start = i
                    while start > low and self.at(start - 1) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*"):
                        start -= 1
                    self.define(self.t[i], "function", scope.container, start, self.shut(body), doc=True)
                    self.walk(open_ + 1, self.shut(open_), _Scope(self.t[i]))
                    self.walk(body + 1, self.shut(body), _Scope(self.t[i]))
                    i = self.shut(body) + 1
                    continue
                i = self.shut(open_) + 1
                continue
            if self.at(i) == "=":
                stop = next((k for k in self.top(i, end) if self.at(k) == ";" or (k > i + 1 and self.line(self.s.tokens[k][1]) > self.line(self.s.tokens[k - 1][1]))), end)
                self.walk(i + 1, stop, scope)
                i = max(stop, i + 1)
                continue
            if self.at(i) == "@" and self.name(i + 1) and self.at(i + 2) == "(":
                self.call(self.t[i + 1], "func", i + 1, scope)
                i = self.shut(i + 2) + 1
                continue
            i = self.shut(i) + 1 if self.at(i) in ("(", "[", "{") else i + 1

    def assigned(self, i: int, end: int) -> int | None:
        """Where the function value of the variable at i begins."""
        k = i + 1
        if self.at(k) == ":":  # a type: up to the = outside brackets
            k = next((j for j in self.top(k, end) if self.at(j) in ("=", ";")), end)
        if self.at(k) != "=":
            return None
        k += 1
        start = k
        k += self.at(k) == "async"
        if self.at(k) == "function":
            return start
        if self.name(k) and self.at(k + 1) == "=>":
            return start
        if self.at(k) == "(":
            j = self.shut(k) + 1
            if self.at(j) == ":":
                while j < end and self.at(j) not in ("=>", ";", "="):
                    j = self.shut(j) + 1 if self.at(j) in ("(", "[", "{") else j + 1
            return start if self.at(j) == "=>" else None
        return None

    def bound_function(self, i: int, value: int, end: int) -> int:
        arrow = next((k for k in self.top(value, end) if self.at(k) in ("=>", "{")), end)
        body = arrow if self.at(arrow) == "{" else arrow + 1
        if self.at(body) == "{":
            stop = self.shut(body)
        else:
            stop, k = body, body
            for k in self.top(body, end):
                if self.at(k) in (";", ",", ")", "}", "]") or (k > body and self.at(k - 1) not in ("=>", "(", ",", "+", "?", ":", "&", "|", ".") and self.at(k) not in (".", "?", ":", "+", "&", "|") and self.line(self.s.tokens[k][1]) > self.line(self.s.tokens[k - 1][2] - 1)):
                    break
                stop = self.shut(k) if self.at(k) in ("(", "[", "{") else k
        self.define(self.t[i], "function", None, i, stop)
        self.walk(body + 1 if self.at(body) == "{" else body, stop + (self.at(body) != "{"), _Scope(self.t[i]))
        return stop + 1

    def script_import(self, i: int, end: int) -> int:
        k = i + 1
        while k < end and not self.at(k).startswith('"') and self.at(k) != ";":
            k = self.shut(k) + 1 if self.at(k) == "{" else k + 1
        self.facts.imports.append((self.raw(i, k + (self.at(k + 1) == ";")), self.line(self.s.tokens[i][1])))
        if self.at(k).startswith('"'):
            a, b = self.s.tokens[k][1:]
            module = self.s.text[a + 1 : b - 1]
            j = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) != "from")
            if self.name(j):
                self.facts.import_names.append((self.t[j], module))
            if (brace := next((j for j in range(i, k) if self.at(j) == "{"), None)) is not None:
                j = brace + 1
                while j < self.shut(brace):
                    if self.name_text(self.at(j)):
                        j += self.at(j) == "type" and self.name_text(self.at(j + 1)) and self.at(j + 1) != "as"
                        if self.at(j + 1) == "as":
                            self.facts.import_names.append((self.t[j + 2], module))
                            self.facts.aliases.append((self.t[j + 2], self.t[j]))
                            j += 2
                        else:
                            self.facts.import_names.append((self.t[j], module))
                    j += 1
        return min(k + 1 + (self.at(k + 1) == ";"), end)


def parse_braces(text: str, lang: str) -> Facts:
    return Scanner(text, lang).run()
