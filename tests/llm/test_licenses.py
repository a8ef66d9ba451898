from __future__ import annotations

import random
import re

import numpy as np
import pytest

from graphloom.llm.kernel import words_of
from graphloom.llm.licenses import TEMPLATES, align, align_rows, full_texts, scan_licenses, winnow
from tests.llm.conftest import prose


def hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), folded=True).hashes


def test_a_shared_run_shares_a_fingerprint():
    r = random.Random(1)
    for _ in range(50):
        run = prose(r, 5)
        a, b = hashes(f"{prose(r, 9)} {run} {prose(r, 4)}"), hashes(f"{run} {prose(r, 7)}")
        (_, x), (_, y) = (winnow(w, np.array([0, len(w)])) for w in (a, b))
        assert set(x) & set(y)


def split(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def inside(key: str, words: list[str]) -> bool:
    """The key's words in a row, not going on with a further number."""
    k = split(key)
    for i in range(len(words) - len(k) + 1):
        after = words[i + len(k)] if i + len(k) < len(words) else ""
        if words[i : i + len(k)] == k and not (k[-1].isdigit() and after.isdigit() and 0 < int(after) <= 30):
            return True
    return False


def brute(text: str, coverage: float = 0.8, templates=TEMPLATES):
    """The licence of the best alignment, by strings: no hashes, candidates or band."""
    doc, best = split(text), None
    for order, t in enumerate(templates):
        words = split(t.text)
        if not all(inside(k, doc) for k in t.keys):
            continue
        # (score, matched words) of the best alignment of the words so far that ends at each place of the document
        row = [(0, 0)] * (len(doc) + 1)
        for w in words:
            new = [(row[0][0] - 1, row[0][1])]
            for j, d in enumerate(doc, 1):
                equal = (row[j - 1][0] + 2, row[j - 1][1] + 1) if d == w else (row[j - 1][0] - 1, row[j - 1][1])
                new.append(max(equal, (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1]), key=lambda x: x[0]))
            row = new
        score, matched = max(row, key=lambda x: x[0])
        if matched >= (len(words) if len(words) < 10 else coverage * len(words)) and (best is None or score > best[0]):
            best = (score, t.name)
    return best[1] if best else None


def test_notices_with_changes_are_found_as_brute_force_finds_them(spark, odd, none, docs_of):
    r = random.Random(4)
    texts = []
    for t in (x.text for x in TEMPLATES):
        words = t.split()
        texts.append(f"{prose(r, 20)}\n{t}. {prose(r, 10)}")
        if len(words) > 9:
            words[r.randrange(2, 4)] = "changed"
            words.insert(7, "inserted")
            texts.append(f"é {' '.join(words).upper()} {prose(r, 5)}")
    texts += [prose(r, 200), "licensed under the", "Released under no licence", None, "", prose(r, 30_000) + " Released under the MIT License."]
    docs = docs_of(texts)
    got = {r_["doc_id"]: r_ for r_ in scan_licenses(docs, templates=TEMPLATES).collect()}
    for i, t in enumerate(texts):
        want = brute(t) if t and len(t) < 5000 else ("MIT" if t else None)
        assert (got[i]["license"] if i in got else None) == want, t
        if i in got:
            assert got[i]["coverage_percent"] >= 80
    mit = got[1]
    assert texts[1][mit["start_char"] : mit["end_char"]] == "Released under the MIT License" and mit["coverage_percent"] == 100
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0
    assert scan_licenses(docs_of(["Released under the MIT License. " * 2 + "Licensed under CC BY-NC 4.0."])).count() == 3


def test_rows_of_cells_align_as_cells_do():
    r = random.Random(8)
    for _ in range(200):
        t, d = (np.array([r.randrange(4) for _ in range(r.randrange(1, 12))], np.uint64) for _ in range(2))
        low, high = sorted((r.randrange(-6, 8), r.randrange(-6, 8)))
        want = align(t, d, low, high)
        assert align_rows(t, d, low, high) == want or want[0] < -(10**8)  # no cell in the band


def test_whole_licences_and_standard_notices(spark, docs_of):
    r = random.Random(6)
    texts, want = [], []
    for name, text, _ in full_texts():
        words = text.split(" ")
        for _ in range(len(words) // 50):
            words[r.randrange(3, len(words) - 3)] = "changed"
        texts.append(f"{prose(r, 40)} \n{' '.join(words)}\n {prose(r, 40)}")
        want.append([(name, len(texts[-1]) // 100 * 90)])
    fsf = "foo is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    notices = [
        ("GPL-3.0", fsf.format("", 3)), ("GPL-2.0", fsf.format("", 2)), ("LGPL-2.1", fsf.format("Lesser ", 2.1)), ("AGPL-3.0", fsf.format("Affero ", 3)),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("CC-BY-NC-SA-3.0", "It is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ]
    for name, text in notices:
        texts.append(f"{prose(r, 20)} {text} {prose(r, 20)}")
        want.append([(name, 40)])
    got = {}
    for x in scan_licenses(docs_of(texts)).collect():
        got.setdefault(x["doc_id"], []).append((x["license"], x["end_char"] - x["start_char"]))
    for i, ((name, least),) in enumerate(want):
        assert [k for k, _ in got[i]] == [name] and got[i][0][1] > min(least, len(texts[i]) - 800), (name, got[i])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the Apache License", ["Apache"]), ("Released under the BSD License", ["BSD"]), ("Licensed under the Eclipse License", []), ("Licensed under the Eclipse Public License 2.0", ["EPL-2.0"]),
        ("licensed under the GNU General Public License version 3", ["GPL-3.0"]), ("it was sold with the MIT license plate", []), ("licensed under the GNU General Public License version 4", ["GPL"]),
        ("This work is licensed under the GNU General Public License, version 4", ["GPL"]), ("Licensed under CC BY 3.0", ["CC-BY-3.0"]), ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]), ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]), ("SPDX-License-Identifier: LGPL-2.1", ["LGPL-2.1"]), ("SPDX-License-Identifier: Nonsense", []),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
        ("free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ["GPL-2.0"]),
        ("distributed under the terms of the Mozilla Public License, v. 2.0", ["MPL-2.0"]), ("Available under the ISC License.", ["ISC"]), ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
    ],
)
def test_near_misses_have_their_own_name(text, want):
    r = random.Random(text)
    text = f"{prose(r, 12)}. {text}. {prose(r, 12)}"
    found = matches_of(text)
    assert found == want


def matches_of(text: str) -> list[str]:
    from graphloom.llm.licenses import all_templates, build_index, matches

    index = matches_of.__dict__.setdefault("index", build_index(all_templates()))
    doc = hashes(text)
    at, h = winnow(doc, np.array([0, len(doc)]))
    near = np.isin(h, index.prints)
    return [index.names[x[0]] for x in matches(doc, at[near], h[near], index, 0.8)]


def test_precision_and_recall_on_changed_bodies():
    """Licences with a word in twenty changed, and texts of like words in another order."""
    r = random.Random(2)
    right = wrong = 0
    for name, text, _ in full_texts():
        words = text.split(" ")
        if len(words) > 1500:
            continue
        for _ in range(2):
            changed = [r.choice(["changed", "other", w]) if r.random() < 0.07 else w for w in words]
            right += name in matches_of(f"{prose(r, 9)} {' '.join(changed)} {prose(r, 9)}")
            shuffled = words[:]
            r.shuffle(shuffled)
            wrong += len(matches_of(" ".join(shuffled)))
    assert right >= 14 and wrong == 0


def test_many_notices_take_no_long_and_names_may_clash(spark):
    from time import perf_counter

    began = perf_counter()
    assert len(matches_of("Licensed under CC BY 4.0. word word word " * 3000)) == 3000 and perf_counter() - began < 30
    docs = spark.createDataFrame([(3, "Released under the MIT License")], "license long, `t.x` string")
    found = scan_licenses(docs, id_col="license", text_col="t.x")
    assert found.columns[:2] == ["license", "license_"] and [tuple(x)[:2] for x in found.collect()] == [(3, "MIT")]
