from __future__ import annotations

from graphloom.functions.parse.brace import parse_braces
from graphloom.functions.parse.python import parse_python, simple_type
from graphloom.functions.parse.registry import language
from graphloom.sources import git


def defs(f):
    return [(d.name, d.kind, d.parent_class, d.start_line, d.end_line) for d in f.defs]


def calls(f):
    return [(c.name, c.call_kind, c.enclosing, c.receiver_class) for c in f.calls]


def test_python_walk():
    f = parse_python(
        'import a.b\nfrom m import x as y, z\nfrom . import q\nfrom n import *\n\n@deco(1)\nclass C(Base):\n    """First.\n    Second."""\n    if True:\n        def m(self, p: "D" = f()):\n'
        "            self.m()\n            p.go()\n            def inner():\n                self.k()\n            return C().n()\n    def o(self): return a[0]()\n\nx.y().z()\n"
    )
    assert defs(f) == [("C", "class", None, 7, 17), ("m", "function", "C", 11, 16), ("inner", "function", None, 14, 15), ("o", "function", "C", 17, 17)]
    assert f.defs[0].docstring == "First." and f.defs[0].base_class == "Base" and f.defs[1].signature.startswith("def m(self")
    assert calls(f) == [
        ("deco", "func", "<module>", None), ("f", "func", "m", None), ("m", "method", "m", "C"), ("go", "method", "m", "D"),
        ("k", "method", "inner", "C"), ("n", "method", "m", "C"), ("C", "func", "m", None), ("z", "method", "<module>", None), ("y", "method", "<module>", None),
    ]
    assert f.aliases == [("y", "x")] and f.import_names == [("y", "m"), ("z", "m")] and len(f.imports) == 4


def test_bindings_of_several_classes_give_no_hint():
    f = parse_python("def f():\n    x = A()\n    x = B()\n    x.go()\n    y = A()\n    y.go()\n")
    assert [c.receiver_class for c in f.calls if c.name == "go"] == [None, "A"]


def test_types():
    import ast

    of = lambda s: simple_type(ast.parse(s, mode="eval").body)
    assert [of(x) for x in ("T", "'T'", "Optional[T]", "T | None", "None | T")] == ["T"] * 5
    assert [of(x) for x in ("list[T]", "A | B", "a.T", "typing.Optional[T]", "'a.T'", "Optional[A, B]")] == [None] * 6


def test_sources_that_do_not_compile():
    f = parse_python("def f(x):\n    print 1\n    foo(x)\nclass A(B):\n    def m(self):\n        self.q(1)\n")
    assert [d[:3] for d in defs(f)] == [("f", "function", None), ("A", "class", None), ("m", "function", "A")]
    assert [c[:3] for c in calls(f)] == [("foo", "func", "f"), ("q", "method", "m")]
    assert parse_python("%% ?? ]) this is { prose ) and ( no source").empty() and parse_python("# only a comment\n").empty()
    assert not parse_python("x = f(\0)\n").defs


def test_literals_and_comments_hold_no_calls():
    f = parse_braces('fn a() { let s = "x(1) { "; /* b(2) } */ c(3); // d(4)\n let r = r#"e(5)"#; let q = \'{\'; }\nfn z() {}\n', "rust")
    assert [c[0] for c in calls(f)] == ["c"] and [d[0] for d in defs(f)] == ["a", "z"]
    f = parse_braces("const g = (x) => { return `t ${h(x)} ${`n ${k()}`}`; };\nconst re = /f(1)\\/{/;\nfunction l() { return m(); }\n", "javascript")
    assert [c[0] for c in calls(f)] == ["h", "k", "m"] and [d[0] for d in defs(f)] == ["g", "l"]


def test_doc_comments():
    f = parse_braces("/// One.\n/// Two.\npub fn a() {}\n// plain\nfn b() {}\n/** Three. */\nstruct C;\n", "rust")
    assert [d.docstring for d in f.defs] == ["One.", None, "Three."]


def test_declarations_are_no_calls():
    f = parse_braces("#define M(x) f(x)\nint decl(int);\nstatic int *own(void) {\n  int v = g(1);\n  return h(v);\n}\n", "c")
    assert [c[0] for c in calls(f)] == ["g", "h"] and defs(f) == [("own", "function", None, 3, 6)]
    f = parse_braces("class A {\n  @Ann(1) int f(int x) { if (x > 0) { return g(new B(1)); } return super.h(); }\n  A() { k(); }\n  enum E { P(1), Q(2); int r() { return s(); } }\n}\n", "java")
    assert [c[0] for c in calls(f)] == ["g", "h", "k", "s"]
    assert [(d[0], d[2]) for d in defs(f)] == [("A", None), ("f", "A"), ("A", "A"), ("E", "A"), ("r", "E")]


def test_languages():
    assert [language(p) for p in ("a/b.py", "x.tsx", "y.PY", "noext", ".py", "z.hh")] == ["python", "typescript", None, None, None, "cpp"]


def test_diff():
    text = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@ f\n@@ -9,2 +10,0 @@\n--- a/gone.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n"
    assert git.parse_diff(text) == ({"x.py": [(1, 2), (10, 10)], "new.py": [(1, 1)]}, ["gone.py"])
    assert git.porcelain_paths(' M a.py\nR  "o.py" -> n.py\n?? d/e.py\nx\n') == ["a.py", "o.py", "n.py", "d/e.py"]


def test_texts_of_elements_hold_no_calls():
    f = parse_braces("const A = () => (<p className={cx('a')}>it's (nothing) {b(1)} <C.D on={() => { e(2); }} /> </p>);\nconst g = a < b(3) && c > (4);\nconst h = <>{k(5)} x(y)</>;\nl(6);\n", "javascript")
    assert [c[0] for c in calls(f)] == ["cx", "b", "e", "b", "k", "l"]
    f = parse_braces("const b = <T,>(y: T) => g(y); const c = <Foo>h(z);\n", "typescript")
    assert [c[0] for c in calls(f)] == ["g", "h"]


def test_sources_that_do_not_compile_keep_receivers_and_docstrings():
    f = parse_python('class A:\n    """Says."""\n    def m(self):\n        \'It does.\'\n        self.q(1); other.self.r()\nprint 1\n')
    assert [d.docstring for d in f.defs] == ["Says.", "It does."] and calls(f) == [("q", "method", "m", "A"), ("r", "method", "m", None)]


def test_samples_have_the_facts_written_by_hand(spark):
    from graphloom.plans import samples

    for name, want in samples.FACTS.items():
        got = [tuple(r) for r in samples.facts(spark, name).collect()]
        assert sorted(got) == sorted((f, n, d or "-", o or "-", -1 if line is None else line) for f, n, d, o, line in want), name
