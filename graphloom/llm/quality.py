"""Operator 7: quality classification with hierarchical empirical Bayes.

A logistic classifier, fitted on a bounded sample of labelled documents, gives each document its own
evidence. Hosts and paths within hosts get posterior rates of good documents by grouped aggregation of
that evidence over all documents: a path is shrunk toward its host, a host toward the whole, each by a
strength that the spread between groups determines. A document's log-odds are its evidence, moved by
how far its path's posterior, by the evidence of the other documents there, lies from the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.kernel import Words, gram_hashes, mix, slices, string_bytes, words_of
from graphloom.llm.shared import written

#: Documents of the labelled sample; the only part of the input that is bounded.
SAMPLE = 6_000
#: Chi-square at which a word's prior variance is half of what it is for the most telling words.
CHI2 = 15.0
#: Evidence of a document is held to these log-odds.
CLIP = 12.0

_UPPER, _LETTER, _SYMBOL, _DIGIT, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SYMBOL[[ord(c) for c in "*$%&#!|@~^=<>{}[]\\_+"]] = True
_DIGIT[48:58] = True
_LINE[10] = True
DENSE = 8


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def dense_features(w: Words, raw: np.ndarray) -> np.ndarray:
    """A row of DENSE style measures for each text; an empty text has zeros but for the bias."""
    size, n = np.maximum(np.diff(w.offsets), 1), w.counts
    letters = _per_text(_LETTER[raw], w.offsets)
    same = np.zeros(len(w.hashes) + 1, np.int64)
    if len(w.hashes) > 1:
        np.cumsum(w.hashes[1:] == w.hashes[:-1], out=same[2:])
    inner = np.minimum(w.first[:-1] + 1, w.first[1:])
    repeats = same[w.first[1:]] - same[inner]
    long = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    return np.column_stack([
        np.ones(len(n)),
        np.minimum(1, 4 * _per_text(_UPPER[raw], w.offsets) / np.maximum(letters, 1)),
        np.minimum(1, 8 * _per_text(_SYMBOL[raw], w.offsets) / size),
        np.minimum(1, 4 * repeats / np.maximum(n, 1)),
        (long[w.first[1:]] - long[w.first[:-1]]) / np.maximum(n, 1) / 10,
        np.log1p(n) / 10,
        np.minimum(1, 8 * _per_text(_DIGIT[raw], w.offsets) / size),
        np.minimum(1, 8 * _per_text(_LINE[raw], w.offsets) / size),
    ])


def _featured(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    buf, offsets = string_bytes(column)
    for a, b in slices(offsets):
        raw, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        w = words_of(raw, at, folded=True)
        yield w, dense_features(w, raw)


@dataclass(frozen=True)
class Model:
    """Weights of the style measures and of the presence of words, by sorted hash."""

    dense: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    #: Rate of good documents in the sample.
    base: float

    def logits(self, column: pa.Array) -> np.ndarray:
        """Log-odds of a good document for each text."""
        out = []
        for w, x in _featured(column):
            z = x @ self.dense
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, w.hashes), len(self.words) - 1)
                hit = np.flatnonzero(self.words[at] == w.hashes)
                if len(hit):
                    text = np.searchsorted(w.first, hit, "right") - 1
                    pairs = np.unique(text * len(self.words) + at[hit])
                    np.add.at(z, pairs // len(self.words), self.weights[pairs % len(self.words)])
            out.append(z)
        return np.clip(np.concatenate(out), -CLIP, CLIP) if out else np.empty(0)


def fit(dense: np.ndarray, bags: list[np.ndarray], good: np.ndarray, ridge: float = 0.3) -> Model:
    """Logistic regression on the style measures and all words that two documents of the sample have.

    Every word has a prior of its own: normal around 0, the tighter the less the word's presence differs
    between good and bad documents (by chi-square). So telling words carry the evidence, and the many that
    stand in a document by chance don't spread it thin. Newton steps, each solved by conjugate gradients.
    """
    n = len(good)
    base = (good.sum() + 1) / (n + 2)
    if n == 0 or good.all() or not good.any():
        bias = np.zeros(DENSE)
        bias[0] = np.log(base / (1 - base))
        return Model(bias, np.empty(0, np.uint64), np.empty(0), base)
    values, text = np.concatenate(bags), np.repeat(np.arange(n), [len(b) for b in bags])
    words, code = np.unique(values, return_inverse=True)
    several = np.bincount(code, minlength=len(words)) > 1
    column = np.cumsum(several) - 1
    hit = several[code]
    text, code, words = text[hit], column[code[hit]], words[several]
    k, rate = len(words), 1 - good.mean()
    seen = np.bincount(code, minlength=k).astype(float)
    bad = np.bincount(code, weights=~good[text], minlength=k)
    chi = (bad - seen * rate) ** 2 / (seen * rate * (1 - rate)) * n / np.maximum(n - seen, 1)
    penalty = np.concatenate([np.full(DENSE, 0.01), np.minimum(1e9, ridge * (1 + (CHI2 / np.maximum(chi, 1e-3)) ** 3))])

    def forward(v: np.ndarray) -> np.ndarray:
        return dense @ v[:DENSE] + np.bincount(text, weights=v[DENSE:][code], minlength=n)

    def backward(u: np.ndarray) -> np.ndarray:
        return np.concatenate([dense.T @ u, np.bincount(code, weights=u[text], minlength=k)])

    beta = np.zeros(DENSE + k)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(forward(beta), -30, 30)))
        gradient, w = backward(good - p) - penalty * beta, p * (1 - p)
        scale = penalty + np.concatenate([(dense**2 * w[:, None]).sum(axis=0), np.bincount(code, weights=w[text], minlength=k)])
        step, rest = np.zeros_like(beta), gradient.copy()
        z = rest / scale
        way, size = z.copy(), rest @ z
        for _ in range(60):
            turned = backward(w * forward(way)) + penalty * way
            far = size / (way @ turned)
            step += far * way
            rest -= far * turned
            if np.abs(rest).max() <= 1e-7 * np.abs(gradient).max():
                break
            z = rest / scale
            way, size = z + rest @ z / size * way, rest @ z
        beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return Model(beta[:DENSE], words, beta[DENSE:], base)


def _sketch(words: np.ndarray) -> bytes:
    """Four least values of differently mixed runs of three words: near copies share one almost surely."""
    grams = gram_hashes(words, 3) if len(words) >= 3 else words
    return np.array([mix(grams ^ np.uint64(s)).min() if len(grams) else s for s in range(1, 5)], np.uint64).tobytes()


def _distinct(sketches: list[bytes]) -> list[int]:
    """Numbers of the documents that share no value of their sketches with an earlier one that is kept."""
    kept, seen = [], set()
    for i, x in enumerate(sketches):
        mine = {(k, v) for k, v in enumerate(np.frombuffer(x, np.uint64).tolist())}
        if not mine & seen:
            kept.append(i)
            seen |= mine
    return kept


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `sample` labelled documents, taken by hash of the id; good means quality 1 and not toxic.

    Labels with a null in any of the three columns are left out; of repeated labels of a document the worst counts.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    chosen = (
        labels.select(F.col("doc_id").alias("label_id"), good.alias("label_good")).where("label_id is not null and label_good is not null")
        .groupBy("label_id").agg(F.min("label_good").alias("label_good"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    rows = rows.join(F.broadcast(chosen), "label_id").select("label_id", "label_good", "t")  # bounded by `sample`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, bags, sketches = [], [], []
            for w, x in _featured(batch.column(2)):
                dense += [r.tobytes() for r in x]
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    bags.append(np.unique(w.hashes[a:b]).tobytes())
                    sketches.append(_sketch(w.hashes[a:b]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.binary()) for x in (dense, bags, sketches))], names=["i", "good", "dense", "bag", "sketch"])

    kind = rows.schema["label_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"i {kind}, good boolean, dense binary, bag binary, sketch binary").toArrow().sort_by([("i", "ascending")])
    found = found.take(pa.array(_distinct(found["sketch"].to_pylist()), pa.int64()))  # copies of a document aren't evidence of its words
    dense = np.array([np.frombuffer(x) for x in found["dense"].to_pylist()]).reshape(-1, DENSE)
    bags = [np.frombuffer(x, np.uint64) for x in found["bag"].to_pylist()]
    return fit(dense, bags, np.array(found["good"].to_pylist(), bool))


def _evidence(rows: DataFrame, model: Model, text: int, keep: list[int]) -> DataFrame:
    """The columns at `keep` of rows, and q_logit, a document's own log-odds; names of rows must be free of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(model.logits(batch.column(text)))], names=[*(batch.schema.names[i] for i in keep), "q_logit"])

    return rows.mapInArrow(run, T.StructType([rows.schema[i] for i in keep] + [T.StructField("q_logit", T.DoubleType())]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


#: A document's own evidence as whole millionths, so that no order of addition shows.
_P = "cast(round(1e6 / (1 + exp(-q_logit))) as bigint)"


def site_sums(evidence: DataFrame) -> DataFrame:
    """From (q_host, q_path, q_logit): a row a path with its sums (n, s), its host's (hn, hs), the global rate g and the strengths host_k, path_k.

    Strengths come from the spread between groups beyond what their sizes explain (method of moments),
    between 1 and a million.
    """
    paths = evidence.select("q_host", "q_path", F.expr(_P).alias("p")).groupBy("q_host", "q_path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.expr("p * p div 1000000")).alias("ss"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("q_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    whole = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), F.sum("hss").alias("gss"), F.sum(F.expr("double(hn) * hn")).alias("gn2"), F.count("*").alias("gk"))
    rate = lambda s, n: f"({s} / 1e6 / {n})"

    def strength(s: str, n: str, mean: str, k: str, total: str, squares: str, within: str) -> Column:
        between = F.sum(F.expr(f"{n} * power({rate(s, n)} - {mean}, 2)"))
        spread = (between - (F.max(k) - 1) * F.max(within)) / F.greatest(F.lit(1.0), F.max(total) - F.max(squares) / F.max(total))
        m = F.max("g")
        return F.least(F.lit(1e6), F.greatest(F.lit(1.0), m * (1 - m) / F.greatest(F.lit(1e-9), spread) - 1))

    g = whole.select("gn", "gn2", "gk", F.expr("least(1 - 1e-4, greatest(1e-4, gs / 1e6 / gn))").alias("g"), F.expr("greatest(1e-9, gss / 1e6 / gn - power(gs / 1e6 / gn, 2))").alias("within"))
    one = F.broadcast  # single rows
    h = hosts.crossJoin(one(g))
    host_strength = h.agg(strength("hs", "hn", "g", "gk", "gn", "gn2", "within").alias("host_k"))
    hosts = h.crossJoin(one(host_strength)).select("q_host", "hn", "hs", "g", "gn", "within", "host_k", F.expr("(hs / 1e6 + host_k * g) / (hn + host_k)").alias("mean"))
    size = paths.agg(F.count("*").alias("pk"), F.sum(F.expr("double(n) * n")).alias("pn2"))
    x = paths.join(hosts.withColumnRenamed("q_host", "h"), F.col("q_host").eqNullSafe(F.col("h"))).drop("h").crossJoin(one(size))
    path_strength = x.agg(strength("s", "n", "mean", "pk", "gn", "pn2", "within").alias("path_k"))
    return x.crossJoin(one(path_strength)).select(F.col("q_host").alias("site_host"), F.col("q_path").alias("site_path"), "n", "s", "hn", "hs", "g", "host_k", "path_k")


def _judged(evidence: DataFrame, sites: DataFrame) -> DataFrame:
    """evidence with q_global, q_host_rate, q_path_rate and q_posterior; the rates leave out the document itself."""
    on = F.col("q_host").eqNullSafe(F.col("site_host")) & F.col("q_path").eqNullSafe(F.col("site_path"))
    moved = F.col("q_logit") + _logit(F.col("q_path_rate")) - _logit(F.col("q_global"))
    return (
        evidence.join(sites, on).withColumn("q_own", F.expr(_P)).withColumnRenamed("g", "q_global")
        .withColumn("q_host_rate", F.expr("((hs - q_own) / 1e6 + host_k * q_global) / (hn - 1 + host_k)"))
        .withColumn("q_path_rate", F.expr("least(1 - 1e-4, greatest(1e-4, ((s - q_own) / 1e6 + path_k * q_host_rate) / (n - 1 + path_k)))"))
        .withColumn("q_posterior", 1 / (1 + F.exp(-moved)))
        .drop("site_host", "site_path", "n", "s", "hn", "hs", "host_k", "path_k", "q_own")
    )


def score(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: id, q_host, q_path, q_logit, q_global, q_host_rate, q_path_rate, q_posterior.

    host and path are SQL expressions over docs, such as parse_url(url, 'HOST') and parse_url(url, 'PATH');
    documents here have a source and, below it, a language in place of a URL. Rates are those of the other
    documents of the host and path, so that no document's evidence counts twice. Null hosts and paths are
    sites of their own. Null and empty texts are judged by the style measures of an empty text. Repeated
    rows are scored alike, each counting in its site; without usable labels the evidence is a constant. A
    posterior of the threshold itself is kept. An empty table gives no rows. Ids may be of any type.
    """
    model = train(docs, labels, sample=sample, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("q_id"), F.expr(host).cast("string").alias("q_host"), F.expr(path).cast("string").alias("q_path"), F.col(f"`{text_col}`").alias("q_text"))
    evidence = written(_evidence(rows, model, 3, [0, 1, 2]), "quality")
    judged = _judged(evidence, written(site_sums(evidence), "sites"))
    return judged.select(F.col("q_id").alias(id_col), "q_host", "q_path", "q_logit", "q_global", "q_host_rate", "q_path_rate", "q_posterior")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, host: str = "source", path: str = "lang", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, in their columns, whose posterior reaches threshold. See score().

    Texts are featured once and written with their evidence; site posteriors come from the narrow columns
    of that table. Sites of a small table go to every executor; a larger one is joined by a shuffle.
    """
    model = train(docs, labels, sample=sample, id_col=id_col, text_col=text_col)
    width = len(docs.columns)
    # Numbered columns can't clash with those that are added.
    rows = docs.select("*", F.expr(host).cast("string"), F.expr(path).cast("string")).toDF(*(f"c{i}" for i in range(width)), "q_host", "q_path")
    evidence = written(_evidence(rows, model, docs.columns.index(text_col), list(range(width + 2))), "quality")
    judged = _judged(evidence, written(site_sums(evidence), "sites"))
    return judged.where(F.col("q_posterior") >= threshold).select(*(f"c{i}" for i in range(width))).toDF(*docs.columns)
