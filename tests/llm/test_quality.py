from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm.quality import _judged, keep_good, score, site_sums
from tests.llm.conftest import SCHEMA, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def sample(spark):
    """Good prose, shouting junk and documents with insults; half of them labelled."""
    r = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        kind, n = ("good", "good", "junk", "toxic")[i % 4], r.randrange(30, 120)
        text = prose(r, n)
        if kind == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == "toxic":
            words = text.split()
            for _ in range(3):
                words[r.randrange(n)] = r.choice(["vilefoo", "vilebar"])
            text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return spark.createDataFrame(rows, SCHEMA), labels


def test_held_out_accuracy(spark, sample):
    docs, labels = sample
    train = spark.createDataFrame([x for x in labels if x[0] % 2 or x[0] % 3 == 0], LABELS)
    kept = {r["doc_id"] for r in keep_good(docs, train).collect()}
    held = [x for x in labels if not (x[0] % 2 or x[0] % 3 == 0)]
    right = sum((i in kept) == (q == 1 and t == 0) for i, q, t in held)
    assert right / len(held) > 0.97
    assert keep_good(docs, train).columns == docs.columns


def by_hand(rows):
    """{row: (global rate, host rate, path rate, posterior)} from (host, path, logit), each row without itself at its own sites."""
    def clip(x):
        return min(1 - 1e-4, max(1e-4, x))

    def spread(groups, mean, within, total):
        between = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in zip(groups, mean, strict=True))
        return (between - (len(groups) - 1) * within) / max(1.0, total - sum(len(v) ** 2 for v in groups) / total)

    p = [round(1e6 / (1 + math.exp(-z))) / 1e6 for *_, z in rows]
    n, g = len(p), clip(sum(p) / len(p))
    within = max(1e-9, sum(x * x for x in p) / n - (sum(p) / n) ** 2)
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, q, _), x in zip(rows, p, strict=True):
        hosts[h].append(x)
        paths[h, q].append(x)
    strength = lambda s: min(1e6, max(1.0, g * (1 - g) / max(1e-9, s) - 1))
    host_k = strength(spread(list(hosts.values()), [g] * len(hosts), within, n))
    mean = {h: (sum(v) + host_k * g) / (len(v) + host_k) for h, v in hosts.items()}
    path_k = strength(spread(list(paths.values()), [mean[h] for h, _ in paths], within, n))
    out = []
    for (h, q, z), x in zip(rows, p, strict=True):
        host = (sum(hosts[h]) - x + host_k * g) / (len(hosts[h]) - 1 + host_k)
        path = clip((sum(paths[h, q]) - x + path_k * host) / (len(paths[h, q]) - 1 + path_k))
        out.append((g, host, path, 1 / (1 + math.exp(-(z + math.log(path / (1 - path)) - math.log(g / (1 - g)))))))
    return out


def test_posteriors_are_those_by_hand(spark):
    r = random.Random(3)
    rows = [(h, q, r.gauss(m, 1.5)) for h, q, m, n in [("big", "p", 3, 200), ("big", "q", -3, 150), ("bad", "p", -3, 100), ("few", "p", -3, 2), ("one", None, 2, 1), (None, None, 3, 1)] for _ in range(n)]
    evidence = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, q_host string, q_path string, q_logit double")
    got = {x["i"]: x for x in _judged(evidence, site_sums(evidence)).collect()}
    want = by_hand(rows)
    for i, x in enumerate(want):
        assert np.allclose([got[i][c] for c in ("q_global", "q_host_rate", "q_path_rate", "q_posterior")], x, atol=2e-5), i
    rate = {(h, q): x[2] for (h, q, _), x in zip(rows, want, strict=True)}
    assert rate["big", "p"] > 0.85 and rate["big", "q"] < 0.2 and rate["bad", "p"] < rate["few", "p"] < want[0][0]  # two documents say less than a hundred


def test_a_document_alone_on_its_site_has_its_own_evidence_only(spark):
    rows = [(i, "h", "p", 1.0) for i in range(50)] + [(99, "alone", "x", -1.0)]
    evidence = spark.createDataFrame(rows, "i long, q_host string, q_path string, q_logit double")
    got = {x["i"]: x for x in _judged(evidence, site_sums(evidence)).collect()}[99]
    assert abs(got["q_path_rate"] - got["q_global"]) < 1e-9 and abs(got["q_posterior"] - 1 / (1 + math.e)) < 1e-9


def test_hosts_and_paths_from_urls_with_any_id_and_column_names(spark, sample):
    docs, labels = sample
    urls = docs.selectExpr("concat('d', doc_id) AS `the.id`", "text AS q_logit", "concat('http://h', doc_id % 3, '.org/', lang, '?x=', doc_id) AS url", "1 AS site_host", "2 AS `q.x`")
    named = spark.createDataFrame([(f"d{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    sites = {"host": "parse_url(url, 'HOST')", "path": "parse_url(url, 'PATH')", "id_col": "the.id", "text_col": "q_logit"}
    got = score(urls, named, **sites)
    assert got.columns[0] == "the.id" and {(r["q_host"], r["q_path"]) for r in got.collect()} == {(f"h{k}.org", "/en") for k in range(3)}
    kept = keep_good(urls, named, **sites)
    assert kept.columns == urls.columns and 250 < kept.count() < 350


def test_site_evidence_moves_a_doubtful_document(spark, sample):
    docs, labels = sample
    got = score(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600
    for r in got:
        up = r["q_path_rate"] > r["q_global"]
        own = 1 / (1 + np.exp(-r["q_logit"]))
        assert up == (r["q_posterior"] > own) or abs(r["q_path_rate"] - r["q_global"]) < 1e-9 or own in (0, 1) or abs(r["q_posterior"] - own) < 1e-6


def test_odd_rows_and_labels(spark, odd, none, sample):
    docs, labels = sample
    messy = spark.createDataFrame([*labels[:200], (1, None, 0), (None, 1, 0), (0, 0, 0), (5, 1, 0), (999_999, 1, 0)], LABELS)
    assert keep_good(docs, messy).count() > 150
    empty = spark.createDataFrame([], LABELS)
    assert score(odd, messy).count() == odd.count() and keep_good(odd, empty).columns == odd.columns
    assert {r["q_logit"] for r in keep_good(odd, empty).collect()} == {"clash"}
    assert keep_good(none, messy).count() == 0 and score(none, empty).count() == 0
