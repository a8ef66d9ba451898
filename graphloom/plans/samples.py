"""Small sources in every language, what a parser must find in them, and a query a language.

FACTS is written by hand from the rules of the languages, as (fact, name, detail, owner, line):
a def with its kind, the class it is in and its first line; a doc (for braces, a comment of /// or /**) with its first line; a call with its kind and,
after a colon, the class of its receiver, and where it stands; an import with its line; an alias with what
it stands for; a name with the module that it is from; a base of a class; a failure. Receivers have a class
in Python, for self in Rust, and for the receiver in Go; names of imports are kept where modules are dotted or quoted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import tree

SOURCES: dict[str, dict[str, str]] = {
    "python": {
        "py/shop.py": '''import os.path
from .stock import Shelf, lookup as find

class Cart(Basket):
    """Holds goods."""

    def __init__(self, owner: "Owner"):
        self.owner = owner
        self.shelf = Shelf()

    def add(self, item: Item | None = None):
        item.check()
        self.refresh()
        return find(item)

def total(cart: Cart) -> int:
    shelf = Shelf()
    shelf.scan()
    return sum(cart.prices())

total(Cart(None))
''',
    },
    "python_broken": {
        "py/broken.py": '''def old(x):
    print x
    return helper(x)

class Left(Right):
    """Not right."""
    def turn(self):
        self.spin(1)
''',
        "py/blank.py": "# nothing here\n", "py/junk.py": "]] ?? [[ ((\n",
    },
    "rust": {
        "rs/lib.rs": '''use std::fmt;
use crate::store::{open as open_store, Row};

/// A point.
pub struct Point { x: i32 }

impl Point {
    /// Moves it.
    pub fn shift(&self, by: i32) -> i32 {
        self.check();
        scale(by)
    }
}

fn scale(n: i32) -> i32 {
    let p = Point::new(n);
    p.shift(n)
}
''',
    },
    "go": {
        "go/main.go": '''package main

import "fmt"

// Box holds.
type Box struct{ n int }

// Put puts.
func (b *Box) Put(n int) {
	b.grow(n)
	fmt.Println(n)
}

func run() {
	fill(3)
}
''',
    },
    "c": {
        "c/ring.c": '''#include <stdio.h>

int decl(int);

/* Adds one. */
static int add(int a) {
    return grow(a) + 1;
}

struct node { int v; };

int main(void) {
    puts("call(1)");
    return add(2);
}
''',
    },
    "cpp": {
        "cpp/ring.cpp": '''#include "ring.h"

class Ring : public Base {
public:
    int size() const { return count(); }
    void push(int v);
};

void Ring::push(int v) {
    grow(v);
    this->check();
}
''',
    },
    "csharp": {
        "cs/Bank.cs": '''using System;

namespace Money {
    class Account : Base {
        public int Total() { return Sum(1); }
        void Close() { this.Flush(); }
    }
}
''',
    },
    "java": {
        "java/Tree.java": '''import java.util.List;

class Tree extends Plant {
    int height() { return measure(1); }
    void cut() { saw.start(); }
}
''',
    },
    "javascript": {
        "js/app.jsx": '''import { load as fetchAll, save } from "./api";

class View extends Base {
  draw() { this.clear(); return paint(1); }
}

function page(x) {
  return <div title={label(x)}>plain (not a call) {item(x)} {x && <b>bold (too)</b>}<br/> it's (on) </div>;
}

const tick = () => save(2);
''',
    },
    "typescript": {
        "ts/model.ts": '''import { Row } from "./row";

interface Shape { area(): number; }

export class Box {
  open(n: number): string { return wrap(n); }
}

export function build(n: number): Box {
  return make(n);
}
''',
    },
}

Fact = tuple[str, str, str | None, str | None, int | None]
FACTS: dict[str, list[Fact]] = {
    "python": [
        ("import", "import os.path", None, None, 1), ("import", "from .stock import Shelf, lookup as find", None, None, 2),
        ("alias", "find", "lookup", None, None),
        ("def", "Cart", "class", None, 4), ("doc", "Cart", "Holds goods.", None, 4), ("base", "Cart", "Basket", None, 4),
        ("def", "__init__", "function", "Cart", 7), ("def", "add", "function", "Cart", 11), ("def", "total", "function", None, 16),
        ("call", "Shelf", "func", "__init__", 9), ("call", "check", "method:Item", "add", 12), ("call", "refresh", "method:Cart", "add", 13), ("call", "find", "func", "add", 14),
        ("call", "Shelf", "func", "total", 17), ("call", "scan", "method:Shelf", "total", 18), ("call", "sum", "func", "total", 19), ("call", "prices", "method:Cart", "total", 19),
        ("call", "total", "func", "<module>", 21), ("call", "Cart", "func", "<module>", 21),
    ],
    "python_broken": [
        ("def", "old", "function", None, 1), ("call", "helper", "func", "old", 3), ("def", "Left", "class", None, 5), ("base", "Left", "Right", None, 5), ("doc", "Left", "Not right.", None, 5),
        ("def", "turn", "function", "Left", 7), ("call", "spin", "method:Left", "turn", 8),
        ("failure", "py/blank.py", None, None, None), ("failure", "py/junk.py", None, None, None),
    ],
    "rust": [
        ("import", "use std::fmt;", None, None, 1), ("import", "use crate::store::{open as open_store, Row};", None, None, 2), ("alias", "open_store", "open", None, None),
        ("def", "Point", "class", None, 5), ("doc", "Point", "A point.", None, 5), ("def", "shift", "function", "Point", 9), ("doc", "shift", "Moves it.", None, 9),
        ("def", "scale", "function", None, 15), ("call", "check", "method:Point", "shift", 10), ("call", "scale", "func", "shift", 11), ("call", "new", "method", "scale", 16), ("call", "shift", "method", "scale", 17),
    ],
    "go": [
        ("import", "\"fmt\"", None, None, 3), ("def", "Box", "class", None, 6), ("def", "Put", "function", "Box", 9),
        ("call", "grow", "method:Box", "Put", 10), ("call", "Println", "method", "Put", 11), ("def", "run", "function", None, 14), ("call", "fill", "func", "run", 15),
    ],
    "c": [
        ("import", "#include <stdio.h>", None, None, 1), ("def", "add", "function", None, 6), ("call", "grow", "func", "add", 7),
        ("def", "main", "function", None, 12), ("call", "puts", "func", "main", 13), ("call", "add", "func", "main", 14),
    ],
    "cpp": [
        ("import", '#include "ring.h"', None, None, 1), ("def", "Ring", "class", None, 3), ("def", "size", "function", "Ring", 5), ("call", "count", "func", "size", 5),
        ("def", "push", "function", "Ring", 9), ("call", "grow", "func", "push", 10), ("call", "check", "method", "push", 11),
    ],
    "csharp": [
        ("import", "using System;", None, None, 1), ("def", "Account", "class", None, 4), ("def", "Total", "function", "Account", 5), ("call", "Sum", "func", "Total", 5),
        ("def", "Close", "function", "Account", 6), ("call", "Flush", "method", "Close", 6),
    ],
    "java": [
        ("import", "import java.util.List;", None, None, 1), ("name", "List", "java.util", None, None), ("def", "Tree", "class", None, 3), ("def", "height", "function", "Tree", 4), ("call", "measure", "func", "height", 4),
        ("def", "cut", "function", "Tree", 5), ("call", "start", "method", "cut", 5),
    ],
    "javascript": [
        ("import", 'import { load as fetchAll, save } from "./api";', None, None, 1), ("name", "fetchAll", "./api", None, None), ("name", "save", "./api", None, None), ("alias", "fetchAll", "load", None, None),
        ("def", "View", "class", None, 3), ("def", "draw", "function", "View", 4), ("call", "clear", "method", "draw", 4), ("call", "paint", "func", "draw", 4),
        ("def", "page", "function", None, 7), ("call", "label", "func", "page", 8), ("call", "item", "func", "page", 8), ("def", "tick", "function", None, 11), ("call", "save", "func", "tick", 11),
    ],
    "typescript": [
        ("import", 'import { Row } from "./row";', None, None, 1), ("name", "Row", "./row", None, None), ("def", "Box", "class", None, 5), ("def", "open", "function", "Box", 6), ("call", "wrap", "func", "open", 6),
        ("def", "build", "function", None, 9), ("call", "make", "func", "build", 10),
    ],
}


def facts(spark: SparkSession, sample: str) -> DataFrame:
    """(fact, name, detail, owner, line) that the parsers find in the sample's sources."""
    table = tree.from_texts(spark, SOURCES[sample])
    g = tree.graph_of(table)
    kinds = {
        "def": g.symbols.selectExpr("name", "kind AS detail", "parent_class AS owner", "start_line AS line"),
        "doc": g.symbols.where("docstring is not null").selectExpr("name", "docstring AS detail", "string(null) AS owner", "start_line AS line"),
        "base": g.symbols.where("base_class is not null").selectExpr("name", "base_class AS detail", "string(null) AS owner", "start_line AS line"),
        "call": g.call_sites.selectExpr("name", "concat_ws(':', call_kind, receiver_class) AS detail", "enclosing AS owner", "line"),
        "import": g.imports.selectExpr("raw AS name", "string(null) AS detail", "string(null) AS owner", "line"),
        "alias": g.aliases.selectExpr("local AS name", "source AS detail", "string(null) AS owner", "bigint(null) AS line"),
        "name": g.import_names.selectExpr("local AS name", "source_module AS detail", "string(null) AS owner", "bigint(null) AS line"),
        "failure": g.parse_failures.selectExpr("file AS name", "string(null) AS detail", "string(null) AS owner", "bigint(null) AS line"),
    }
    out = None
    for kind, rows in kinds.items():
        one = rows.select(F.lit(kind).alias("fact"), "name", F.coalesce("detail", F.lit("-")).alias("detail"), F.coalesce("owner", F.lit("-")).alias("owner"), F.coalesce("line", F.lit(-1)).cast("bigint").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def oracle(sample: str) -> str:
    """FACTS of the sample as SQL."""
    quoted = lambda x: "'" + str("-" if x is None else x).replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(f)}, {quoted(n)}, {quoted(d)}, {quoted(o)}, {-1 if line is None else line})" for f, n, d, o, line in FACTS[sample])
    return f"SELECT fact, name, detail, owner, CAST(line AS BIGINT) AS line FROM (VALUES {rows}) AS t(fact, name, detail, owner, line)"
