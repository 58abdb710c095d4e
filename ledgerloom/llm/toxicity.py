"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: its words and their beginnings of PREFIXES letters (so that
endings do not hide a word), hashed to 2^BITS buckets. Each bucket has a weight and a vector of
FACTORS numbers; a pair of terms adds the product of their vectors, so an insult beside the
mention of a group can count for more than either alone. In linear time, the sum over pairs is
((sum v)^2 - sum v^2) / 2.

Learning, on a bounded sample of labelled texts: a term is used if its share among toxic texts differs from that among
others by four standard errors (of more than MAX_TERMS the clearest), or if it is one of a pair of words that tells together: whose co-occurrence, beyond
what their shares in a class explain, differs between the classes by PAIR_ERRORS standard errors (all pairs of the PAIR_WORDS
most frequent words, by a matrix product; the PAIRS clearest). So an insult and a group that are each as common in
clean texts are learned together, while long clean texts do not add up noise. The machine of these terms
is fitted by full gradients (Adam) with a soft threshold on the weights. Classes count
alike, and a logistic fit on values of texts by machines that did not learn from them (in FOLDS parts) calibrates the score. The fitted machine is
a short list of buckets, so buckets can be many (few clashes) and its broadcast stays small: at most one
entry per term of the bounded sample.

Scoring reads each row by itself: no shuffle, memory for one batch. A word is looked up once in
a worker's memory; most words have no term with a weight and cost nothing more.

Cases: a null or empty text has no terms and gets the calibrated score for none; repeated
rows get equal scores; a null id is passed on and counts as the empty string for held_out; an
empty table gives an empty result; without both classes among the labels the score is the
share of toxic ones, 0 with none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labelled import held_out, logistic_1d, training_rows
from ledgerloom.llm.words import CACHE_WORDS, normal_word, slices

MAX_PER_CLASS = 2_500
MAX_CHARS = 24_000_000
BITS = 30
PREFIXES = (4, 5, 6)
FACTORS = 8
PAIR_WORDS, PAIRS, PAIR_ERRORS, PAIR_TEXTS = 1_024, 64, 6.5, 5
FOLDS = 3
MAX_TERMS = 8_192
THRESHOLD = 0.7


def bucket_of(part: str) -> int:
    return xxhash.xxh64_intdigest(part) >> (64 - BITS)


def prefix_terms(start: str) -> list[int]:
    """Buckets of the beginnings of a word that begins so."""
    return [bucket_of(str(k) + start[:k]) for k in PREFIXES if len(start) >= k]


def terms(word: str) -> list[int]:
    """Buckets of a word: of itself, and of its beginnings."""
    w = normal_word(word)
    return [bucket_of("=" + w), *prefix_terms(w)] if w else []


@dataclass(frozen=True)
class Model:
    bias: float
    bucket: np.ndarray  # sorted
    w: np.ndarray
    v: np.ndarray  # a row of factors per bucket


class Terms:
    """Texts as sets of columns: positions in a sorted array of buckets that count."""

    _kept: dict[str, Terms] = {}

    @classmethod
    def of(cls, name: str, buckets: np.ndarray) -> Terms:
        """The terms of a model that this worker keeps from task to task."""
        if name not in cls._kept:
            cls._kept.clear()
            cls._kept[name] = cls(buckets)
        return cls._kept[name]

    def __init__(self, buckets: np.ndarray):
        self.column = {int(b): i for i, b in enumerate(buckets)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.starts: dict[str, tuple[int, ...]] = {}

    def columns(self, word: str) -> tuple[int, ...]:
        """Columns of a word. Beginnings are few and are remembered apart."""
        column, w = self.column, normal_word(word)
        if not w:
            return ()
        start = w[: max(PREFIXES)]
        cols = self.starts.get(start)
        if cols is None:
            if len(self.starts) > CACHE_WORDS:
                self.starts.clear()
            cols = self.starts[start] = tuple({column[b] for b in prefix_terms(start) if b in column})
        own = column.get(bucket_of("=" + w))
        return cols if own is None else (*cols, own)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(column, text) of every term of every text, each once."""
        cols: list[int] = []
        rows: list[int] = []
        known, columns = self.known, self.columns
        for i, t in enumerate(texts):
            if t:
                mine: set[int] = set()
                for word in set(t.split()):
                    got = known.get(word)
                    if got is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        got = known[word] = columns(word)
                    if got:
                        mine.update(got)
                cols += sorted(mine)
                rows += [i] * len(mine)
        return np.array(cols, np.int64), np.array(rows, np.int64)


def raw_scores(model: Model, col: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The machine's value of n texts, before the logistic function."""
    y = model.bias + np.bincount(row, model.w[col], n)
    for f in range(model.v.shape[1]):
        v = model.v[col, f]
        s = np.bincount(row, v, n)
        y += 0.5 * (s * s - np.bincount(row, v * v, n))
    return y


def squeezed(x: np.ndarray) -> np.ndarray:
    """Values for calibration: pairs make those of texts with many terms grow as the square of
    their number, which would flatten the fit where the classes meet."""
    return np.sign(x) * np.log1p(np.abs(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sample:
    """Labelled texts with the buckets of all their terms and of their words alone: (text, bucket), each once."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.y = np.array([y for y, _ in rows], float)
        known: dict[str, tuple[list[int], int | None]] = {}
        parts: tuple[list, list] = ([], [])
        for _, t in rows:
            every: set[int] = set()
            words: set[int] = set()
            for word in set((t or "").split()):
                got = known.get(word)
                if got is None:
                    mine = terms(word)
                    got = known[word] = (mine, mine[0] if mine else None)
                every.update(got[0])
                if got[1] is not None:
                    words.add(got[1])
            for into, found in zip(parts, (every, words), strict=True):
                into.append(np.array(sorted(found), np.int64))
        self.terms, self.words = ((np.repeat(np.arange(len(x)), [len(a) for a in x]), np.concatenate(x or [np.empty(0, np.int64)])) for x in parts)

    def only(self, keep: np.ndarray) -> Sample:
        """The texts where keep is true."""
        out, place = object.__new__(Sample), np.cumsum(keep) - 1
        out.y = self.y[keep]
        out.terms, out.words = ((place[i[keep[i]]], b[keep[i]]) for i, b in (self.terms, self.words))
        return out

    def matrix(self, buckets: np.ndarray) -> np.ndarray:
        """(texts, buckets) of 1 where a text has the term."""
        i, b = self.terms
        at = np.minimum(np.searchsorted(buckets, b), max(len(buckets) - 1, 0))
        x = np.zeros((len(self.y), len(buckets)), np.float32)
        if len(buckets):
            has = buckets[at] == b
            x[i[has], at[has]] = 1
        return x


def _telling(s: Sample, least: float = 4.0) -> np.ndarray:
    """Buckets of terms whose shares among toxic and other texts differ by `least` standard
    errors or more; of more than MAX_TERMS the clearest."""
    i, b = s.terms
    bucket, of = np.unique(b, return_inverse=True)
    n = [(s.y == k).sum() for k in (0, 1)]
    k0, k1 = (np.bincount(of[s.y[i] == k], minlength=len(bucket)) for k in (0, 1))
    p = (k0 + k1) / len(s.y)
    error = np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    z = np.abs(k1 / n[1] - k0 / n[0]) / np.maximum(error, 1e-12)
    ok = np.flatnonzero((k0 + k1 >= 3) & (z >= least) & (error > 0))
    return np.sort(bucket[ok[np.argsort(-z[ok], kind="stable")[:MAX_TERMS]]])


def _telling_pairs(s: Sample) -> np.ndarray:
    """Buckets of words that are in pairs whose co-occurrence tells, sorted."""
    bucket, n = np.unique(s.words[1], return_counts=True)
    often = np.argsort(-n, kind="stable")[:PAIR_WORDS]
    often = np.sort(bucket[often[n[often] >= PAIR_TEXTS]])
    if len(often) < 2:
        return np.empty(0, np.int64)
    x = s.matrix(often)
    beyond, error = [], []
    for y in (0, 1):
        mine = x[s.y == y]
        share = mine.mean(0)
        beyond.append((mine.T @ mine) / len(mine) - share[:, None] * share)
        spread = np.maximum(share * (1 - share), 0.25 / len(mine))
        error.append(spread[:, None] * spread / len(mine))
    z = np.triu(np.abs(beyond[1] - beyond[0]) / np.sqrt(error[0] + error[1]), 1).ravel()
    best = np.flatnonzero(z >= PAIR_ERRORS)
    best = best[np.argsort(-z[best], kind="stable")[:PAIRS]]
    return np.unique(often[np.concatenate(np.unravel_index(best, (len(often), len(often))))])


def fit_texts(rows: list[tuple[int, str]], **how) -> Model:
    """rows: (label, text)."""
    return fit_sample(Sample(rows), **how)


def fit_sample(s: Sample, steps: int = 120, l1: float = 2e-4, l2: float = 1e-4, seed: int = 7) -> Model:
    y, n = s.y, len(s.y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2) if n else 1e-9
        none = np.empty(0)
        return Model(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.empty((0, FACTORS)))
    paired = _telling_pairs(s)
    bucket = np.union1d(_telling(s), paired)
    m, x = len(bucket), s.matrix(bucket)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    # weights and factors side by side, and the bias, moved by Adam; the soft threshold follows each step
    draw = np.random.default_rng(seed).normal(0, 0.05, m * FACTORS).reshape(m, FACTORS)
    p = np.hstack([np.zeros((m, 1)), draw]).astype(np.float32)
    bias = b_mean = b_var = 0.0
    mean, var = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        v = p[:, 1:]
        got = x @ np.hstack([p, (v**2).sum(1, keepdims=True)])
        sums = got[:, 1:-1]
        g = weight * (_sigmoid(bias + got[:, 0] + 0.5 * ((sums**2).sum(1) - got[:, -1])) - y)
        grad = x.T @ np.hstack([g[:, None], g[:, None] * sums]).astype(np.float32)
        grad[:, 1:] -= grad[:, :1] * v
        grad += l2 * p
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        b_mean, b_var = 0.9 * b_mean + 0.1 * g.sum(), 0.999 * b_var + 0.001 * g.sum() ** 2
        rate, fix = 0.05 / (1 - 0.9**t), 1 - 0.999**t
        bias -= rate * b_mean / ((b_var / fix) ** 0.5 + 1e-8)
        p = p - rate * mean / (np.sqrt(var / fix) + 1e-8)
        w = p[:, 0]
        p[:, 0] = np.sign(w) * np.maximum(np.abs(w) - 0.05 * l1, 0)
    keep = np.flatnonzero((p[:, 0] != 0) | np.isin(bucket, paired))
    return Model(float(bias), bucket[keep], p[keep, 0].astype(float), p[keep, 1:].astype(float))


@dataclass(frozen=True)
class Calibrated:
    machine: Model
    slope: float
    intercept: float

    def scores(self, terms_of: Terms, texts: list[str | None]) -> np.ndarray:
        x = squeezed(raw_scores(self.machine, *terms_of(texts), len(texts)))
        return _sigmoid(self.slope * x + self.intercept)


def calibrated(rows: list[tuple[int, str]]) -> Calibrated:
    """A machine of all rows; what scores mean is learned from values of each part by a machine of the others."""
    s = Sample(rows)
    model, fold = fit_sample(s), np.arange(len(rows)) % FOLDS
    x = np.zeros(len(rows))
    for k in range(FOLDS):
        rest, learn = s.only(fold == k), s.only(fold != k)
        if len(set(learn.y)) < 2 or not len(rest.y):
            return Calibrated(model, 1.0, 0.0)
        part = fit_sample(learn)
        i, b = rest.terms
        at = np.minimum(np.searchsorted(part.bucket, b), max(len(part.bucket) - 1, 0))
        has = part.bucket[at] == b if len(part.bucket) else np.zeros(len(b), bool)
        x[fold == k] = squeezed(raw_scores(part, at[has], i[has], len(rest.y)))
    slope, intercept = logistic_1d(x, s.y)
    return Calibrated(model, slope, intercept) if slope > 0 else Calibrated(model, 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Calibrated:
    return calibrated(training_rows(docs, labels, label, MAX_PER_CLASS, MAX_CHARS))


def score_toxicity(
    docs: DataFrame, model: Calibrated, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms_of = Terms.of(name, m.machine.bucket)
        for b in slices(batches, "text"):
            score = m.scores(terms_of, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"]
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
