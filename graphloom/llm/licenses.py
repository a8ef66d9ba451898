"""Operator 4: license scans.

Templates and documents are runs of folded words. The winnowed fingerprints of the templates form an
inverted index (fingerprint -> template, position); a document's winnowed fingerprints pick candidate
templates and diagonals from it, and a banded alignment of template against document around each
diagonal decides, giving coverage and span.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.kernel import Words, gram_hashes, word_slices, words_of
from graphloom.llm.shared import apart

#: Words in a fingerprint; fingerprints in a window, of which the least is kept: a run of GRAM + WINDOW - 1
#: equal words always shares a fingerprint.
GRAM, WINDOW = 3, 3

#: Templates of more words than this are aligned a row at a time by array operations.
LONG = 60

#: Templates of fewer words than this must be matched whole.
SHORT = 10


class Template(NamedTuple):
    """A licence's identifier, a text that names it, and phrases of the text that must stand in the document as they are.

    A phrase that ends in a number isn't matched where the document goes on with a further one: version 2 isn't 2.1.
    """

    name: str
    text: str
    keys: tuple[str, ...] = ()


#: Names of licences in running text: (identifier, forms). The identifier without a version is for names without one.
_NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0")),
    ("Apache", ("Apache License", "Apache Software License")),
    ("MIT", ("MIT License", "MIT Licence", "Expat License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("BSD", ("BSD License",)),
    ("ISC", ("ISC License",)),
    *((f"GPL-{n}.0", tuple(f.format(x) for f in ("GNU General Public License, version {}", "GNU General Public License {}.0", "GNU GPL version {}", "GNU GPL v{}", "GPLv{} license", "GPL version {}") for x in (n,))) for n in (1, 2, 3)),
    ("GPL", ("GNU General Public License", "GNU GPL")),
    *((f"LGPL-{n}", (f"GNU Lesser General Public License, version {n}", f"GNU LGPL version {n}", f"GNU LGPL v{n}", f"LGPL version {n}")) for n in ("2.1", "3")),
    ("LGPL-2.0", ("GNU Library General Public License, version 2",)),
    ("LGPL", ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU AGPL version 3", "GNU AGPL v3")),
    ("AGPL", ("GNU Affero General Public License", "GNU AGPL")),
    *((f"MPL-{n}", (f"Mozilla Public License, version {n}", f"Mozilla Public License, v. {n}", f"Mozilla Public License {n}")) for n in ("1.1", "2.0")),
    ("MPL", ("Mozilla Public License",)),
    *((f"EPL-{n}", (f"Eclipse Public License, version {n}", f"Eclipse Public License v{n}", f"Eclipse Public License - v {n}", f"Eclipse Public License {n}")) for n in ("1.0", "2.0")),
    ("EPL", ("Eclipse Public License",)),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("Artistic-2.0", ("Artistic License 2.0", "Artistic License, Version 2.0")),
    ("Zlib", ("zlib License",)),
    ("WTFPL", ("Do What The Fuck You Want To Public License",)),
    *((f"CC-{k}-{v}", (f"CC {k} {v}", f"CC {k} {v} license")) for k in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND") for v in ("4.0", "3.0", "2.5", "2.0")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3",)),
)
_NAMES = tuple((k if k != "LGPL-3" else "LGPL-3.0", forms) for k, forms in _NAMES)
_UNDER = (*(f"{verb} under{the}" for verb in ("Licensed", "Released", "Distributed", "Available", "Published") for the in (" the", "")), "under the terms of the", "licensed under a")
#: Identifiers of the SPDX list that a tag may give.
_SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "ECL-2.0", "EPL-1.0",
    "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0", "LGPL-2.1",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0",
    "PostgreSQL", "Python-2.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "Zlib", "ZPL-2.1",
)

#: One-line notices; NOTICES has the standard notices, NAMED the names after a verb, SPDX the tags, and full_texts() the licences themselves.
TEMPLATES: tuple[Template, ...] = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License Version 2.0",)),
    Template("MIT", "Released under the MIT License", ("MIT License",)),
    Template("MIT", "Licensed under the MIT License", ("MIT License",)),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("to any person obtaining a copy",)),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License", ("BSD 3-Clause License",)),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", ("with or without fee",)),
    *(Template(k, f"This work is licensed under the {name}, version {n}", (name, f"version {n}")) for k, name, n in (
        ("GPL-2.0", "GNU General Public License", 2), ("GPL-3.0", "GNU General Public License", 3), ("LGPL-3.0", "GNU Lesser General Public License", 3), ("AGPL-3.0", "GNU Affero General Public License", 3),
    )),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License v. 2.0",)),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights", ("waived all copyright",)),
    *(Template(f"CC-{k}-4.0", f"Licensed under CC {k} 4.0", (f"CC {k} 4.0",)) for k in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
)
NAMED: tuple[Template, ...] = tuple(Template(k, f"{under} {name}", (name,)) for k, names in _NAMES for name in names for under in _UNDER)
SPDX: tuple[Template, ...] = tuple(Template(k, f"SPDX-License-Identifier: {k}", (f"SPDX-License-Identifier: {k}",)) for k in _SPDX)

_FSF = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {n} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
_FSF_SHORT = "free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version"
_FSF_ONLY = "free software; you can redistribute it and/or modify it under the terms of the {name} version {n} as published by the Free Software Foundation"
_GNU = (
    ("GPL-1.0", "GNU General Public License", "1"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)
_CC = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))

#: Notices that licences ask for.
NOTICES: tuple[Template, ...] = (
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ("Apache License Version 2.0",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("Mozilla Public License v. 2.0",)),
    *(Template(k, _FSF.format(what=what, name=name, n=n), (name, f"version {n}")) for k, name, n in _GNU for what in ("program", "library")),
    *(Template(k, form.format(name=name, n=n), (name, f"version {n}")) for k, name, n in _GNU for form in (_FSF_SHORT, _FSF_ONLY)),
    *(Template(f"CC-{k}-{v}", f"{verb} Creative Commons {name} {v} {where} License", (f"Creative Commons {name} {v}",)) for verb in ("This work is licensed under a", "licensed under the", "licensed under a") for k, name in _CC for v, where in _CC_VERSIONS),
    # The legal code of 4.0 states its name in this sentence.
    *(Template(f"CC-{k}-4.0", f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License ("Public License")', (f"Creative Commons {name} 4.0",)) for k, name in _CC),
)
_TEXTS = (
    "AGPL-3.0", "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense",
)


@cache
def full_texts() -> tuple[Template, ...]:
    """Whole licences by identifier, from the files of license_texts."""
    return tuple(Template(k, (pkgutil.get_data(__package__, f"license_texts/{k}.txt") or b"").decode()) for k in _TEXTS)


@cache
def all_templates() -> tuple[Template, ...]:
    """One-line notices, standard notices, whole licences, names after a verb and tags, in this order."""
    return TEMPLATES + NOTICES + full_texts() + NAMED + SPDX


def winnow(words: np.ndarray, first: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints): the rightmost least run in every window of runs that stays in one text.

    Windows reach over the ends of texts, where missing runs count as infinite, so a short text and the
    edges of a long one give fingerprints too.
    """
    n = len(words)
    h = np.full(n + window - 1, ~np.uint64(0))
    h[: max(0, n - gram + 1)] = gram_hashes(words, gram)
    for k in range(1, gram):  # runs that cross into the next text
        cut = first[1:-1] - k
        h[cut[cut >= 0]] = ~np.uint64(0)
    padded = np.concatenate([np.full(window - 1, ~np.uint64(0)), h])
    best, at = padded[: n + window - 1].copy(), np.arange(n + window - 1)
    for k in range(1, window):
        x = padded[k : k + n + window - 1]
        less = x <= best
        best[less], at[less] = x[less], np.flatnonzero(less) + k
    picked = np.unique(at[best != ~np.uint64(0)]) - (window - 1)
    return picked, h[picked]


@dataclass(frozen=True)
class Index:
    """Templates as word hashes, and their fingerprints sorted, with template and position of each."""

    names: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    prints: np.ndarray
    template: np.ndarray
    position: np.ndarray
    bags: tuple[tuple[np.ndarray, np.ndarray], ...]  # the different words of each template and how often each occurs
    keys: tuple[tuple[tuple[int, ...], ...], ...]  # phrases that must match, as word hashes


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), folded=True).hashes


@cache
def _numbers() -> frozenset[int]:
    return frozenset(int(_hashes(str(k))[0]) for k in range(31))


@cache
def _zero() -> int:
    return int(_hashes("0")[0])


def stands(doc: list[int], key: tuple[int, ...], start: int, end: int) -> bool:
    """Whether the phrase stands in doc[start:end], and isn't a number cut short."""
    at = start
    while True:
        try:
            at = doc.index(key[0], at, end)
        except ValueError:
            return False
        stop = at + len(key)
        if stop <= end and tuple(doc[at:stop]) == key:
            more = doc[stop] if stop < len(doc) and key[-1] in _numbers() else _zero()
            if more == _zero() or more not in _numbers():
                return True
        at += 1


def build_index(templates: Sequence[tuple[str, ...]]) -> Index:
    """The inverted index; templates of fewer words than a fingerprint has are refused."""
    words, rows, keys = [], [], []
    for k, (name, text, phrases) in enumerate(Template(*t) for t in templates):
        own = _hashes(text)
        if len(own) < GRAM:
            raise ValueError(f"the template {name} has fewer than {GRAM} words")
        words.append(own)
        keys.append(tuple(tuple(_hashes(p).tolist()) for p in phrases))
        at, h = winnow(own, np.array([0, len(own)]))
        rows += [(int(x), k, int(p)) for x, p in zip(h, at, strict=True)]
    rows.sort()
    prints, template, position = zip(*rows, strict=True)
    bags = tuple(np.unique(w, return_counts=True) for w in words)
    return Index(tuple(t[0] for t in templates), tuple(words), np.array(prints, np.uint64), np.array(template), np.array(position), bags, tuple(keys))


def shared_words(bag: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> int:
    """Words that template and document have in common, whatever their order: no alignment matches more."""
    words, counts = bag
    at = np.minimum(np.searchsorted(words, doc), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == doc], minlength=len(words)), counts).sum())


def align(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """(score, matched words, start, end in doc) of the best alignment of the template.

    Cell (i, j) is allowed if low <= j - i <= high. Equal words give 2; a word left out of either, or an
    unequal pair, costs 1; ends of the document are free. Of equal scores the earliest end counts.
    """
    n, m = len(template), len(doc)
    none = (-(10**9), 0, 0)
    row = {j: (0, 0, j) for j in range(max(0, low), min(m, high) + 1)}
    for i in range(1, n + 1):
        new: dict[int, tuple[int, int, int]] = {}
        word = template[i - 1]
        for j in range(max(0, i + low), min(m, i + high) + 1):
            best = none
            if j and j - 1 in row:
                s, k, a = row[j - 1]
                best = (s + 2, k + 1, a) if doc[j - 1] == word else (s - 1, k, a)
            if j in row and row[j][0] - 1 > best[0]:
                best = (row[j][0] - 1, *row[j][1:])
            if j - 1 in new and new[j - 1][0] - 1 > best[0]:
                best = (new[j - 1][0] - 1, *new[j - 1][1:])
            new[j] = best
        row = new
    end = max(row, key=lambda j: (row[j][0], -j), default=-1)
    return (row[end][0], row[end][1], row[end][2], end) if end >= 0 else (-(10**9), 0, 0, 0)


def align_rows(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """align() with a row of cells at a time, for long templates."""
    n, m, none = len(template), len(doc), -(10**9)
    a, b = max(0, low), min(m, high)
    if b < a:
        return none, 0, 0, 0
    score, matched, start = np.full(m + 2, none), np.zeros(m + 2, np.int64), np.zeros(m + 2, np.int64)  # of cell j at j + 1
    score[a + 1 : b + 2] = 0
    start[a + 1 : b + 2] = np.arange(a, b + 1)
    place = np.arange(m + 1)
    words = np.concatenate([doc[:1], doc])  # the word that ends at j
    for i in range(1, n + 1):
        before, a, b = a, max(0, i + low), min(m, i + high)
        if b < a:
            return none, 0, 0, 0
        equal = words[a : b + 1] == template[i - 1]
        best = score[a : b + 1] + np.where(equal, 2, -1)
        skip = score[a + 1 : b + 2] - 1
        up = skip > best
        best = np.where(up, skip, best)
        k = np.where(up, matched[a + 1 : b + 2], matched[a : b + 1] + equal)
        s = np.where(up, start[a + 1 : b + 2], start[a : b + 1])
        raised = best + place[: b + 1 - a]
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, place[: b + 1 - a], 0))
        score[a + 1 : b + 2], matched[a + 1 : b + 2], start[a + 1 : b + 2] = top - place[: b + 1 - a], k[source], s[source]
        if a > before:
            score[a] = none
    end = a + int(np.argmax(score[a + 1 : b + 2]))
    return int(score[end + 1]), int(matched[end + 1]), int(start[end + 1]), end


def _trimmed(template: np.ndarray, doc: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The span without words at its ends that the template lacks."""
    known = np.flatnonzero(np.isin(doc[start:end], template))
    return (start + int(known[0]), start + int(known[-1]) + 1) if len(known) else (start, end)


def matches(doc: np.ndarray, positions: np.ndarray, prints: np.ndarray, index: Index, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(template, start, end, matched, score) found in one document, without overlaps: best score first."""
    low, high = np.searchsorted(index.prints, prints, "left"), np.searchsorted(index.prints, prints, "right")
    hits: dict[int, list[int]] = {}
    for p, a, b in zip(positions.tolist(), low.tolist(), high.tolist(), strict=True):
        for k in range(a, b):
            hits.setdefault(int(index.template[k]), []).append(p - int(index.position[k]))
    found = []
    listed = doc.tolist() if hits else []
    known: dict[tuple[int, ...], bool] = {}
    for t, diagonals in hits.items():
        template = index.words[t]
        for key in index.keys[t]:
            if key not in known:
                known[key] = stands(listed, key, 0, len(listed))
        if not all(known[key] for key in index.keys[t]):
            continue
        need = len(template) if len(template) < SHORT else coverage * len(template)
        long = len(template) > LONG
        if long and (len(doc) < need or shared_words(index.bags[t], doc) < need):
            continue
        band = max(3, len(template) // 4)
        diagonals = sorted(set(diagonals))
        while diagonals:
            group = [d for d in diagonals if d - diagonals[0] <= band]
            diagonals = diagonals[len(group) :]
            base = max(0, group[0] - band)
            piece = doc[base : group[-1] + len(template) + 2 * band]
            if long and shared_words(index.bags[t], piece) < need:
                continue
            score, matched, start, end = (align_rows if long else align)(template, piece, group[0] - band - base, group[-1] + band - base)
            if matched >= need:
                start, end = _trimmed(template, piece, start, end)
                if all(stands(listed, key, base + start, base + end) for key in index.keys[t]):
                    found.append((t, base + start, base + end, matched, score))
    kept: list[tuple[int, int, int, int, int]] = []  # in order, and apart: only the two at x's place can overlap it
    for x in sorted(set(found), key=lambda x: (-x[4], x[1], x[0])):
        at = bisect_left(kept, x[1], key=lambda y: y[1])
        if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or x[2] <= kept[at][1]):
            kept.insert(at, x)
    return kept


def _characters(w: Words, low: int, byte: int) -> int:
    """Characters of the text from byte low to byte."""
    return int(np.count_nonzero((w.buf[low:byte] & 0xC0) != 0x80))


def scan_licenses(docs: DataFrame, *, templates: Sequence[tuple[str, ...]] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, license, template_no, coverage_percent, matched_words, start_char, end_char) for every licence found.

    templates: as Template; without them, all_templates().
    coverage: least part of a template's words that the alignment must match, in order; all of them in
    templates of fewer than SHORT words, and always the template's keys, each in one piece. Where the spans
    of several templates overlap, the one of highest score counts, then the earliest and the first listed.
    Licences named without their version have an identifier without one.
    The index is built from the templates alone and has their size, whatever the documents.

    Null and empty texts have none; a null id is carried along; repeated rows are reported as often as
    they occur; other columns are unused. A result column whose name the id has ends in _.
    """
    index = build_index(all_templates() if templates is None else templates)
    small = np.zeros(1 << 20, bool)
    small[(index.prints & np.uint64(0xFFFFF)).astype(np.int64)] = True
    names = apart([id_col, "license", "template_no", "coverage_percent", "matched_words", "start_char", "end_char"], [])
    kinds = [T.StringType(), *[T.LongType()] * 5]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate([docs.schema[id_col].dataType, *kinds])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for base, w in word_slices(batch.column(1), folded=True):
                at, h = winnow(w.hashes, w.first)
                near = np.flatnonzero(small[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                near = near[np.isin(h[near], index.prints)]
                if not len(near):
                    continue
                text = np.searchsorted(w.first, at[near], "right") - 1
                for t in np.unique(text):
                    mine, a, b = near[text == t], w.first[t], w.first[t + 1]
                    for k, start, end, matched, _ in matches(w.hashes[a:b], at[mine] - a, h[mine], index, coverage):
                        low = w.offsets[t]
                        head = _characters(w, low, w.starts[a + start])
                        rows.append((base + int(t), index.names[k], k, 100 * matched // len(index.words[k]), matched, head, head + _characters(w, w.starts[a + start], w.ends[a + end - 1])))
            if rows:
                at, *rest = (list(x) for x in zip(*rows, strict=True))
                arrays = [pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(rest)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema).toDF(*names)
