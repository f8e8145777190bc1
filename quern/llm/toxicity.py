"""Toxicity: a linear classifier, regularised by counterfactual identity terms.

Features are lower-cased words and word beginnings, chosen on labelled rows by how much more
often documents of one class hold them; each counts as log(1 + occurrences).  The logistic loss has
a second penalty: every sentence of the rows learned from that mentions a group is written again with
each other term of the same kind, and any change of the score's log-odds costs `counterfactual` times
its square.  Sentences without a mention get one at their end, twice, with two terms; so the terms are
tied together, and to zero effect in neutral text, even where the labelled rows scarcely hold them.

A feature's label counts are taken on documents.  Scoring reads whole texts, batch by batch, in numpy.  Defined cases: null and empty texts score
the intercept; no labelled rows: the score is 0 everywhere; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import U64, lean, slices, span_hash
from quern.llm.learn import held_out, training_rows

#: Group mentions that may be swapped for one another, by kind.
IDENTITY_TERMS = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "gender": ["women", "men", "female", "male", "transgender"],
    "orientation": ["gay", "straight", "lesbian", "bisexual"],
    "origin": ["african", "asian", "european", "american", "mexican", "immigrant"],
    "ability": ["deaf", "blind", "disabled", "autistic"],
}
BEGINNINGS = (4, 5, 6)
FEATURES = 3000
CELLS = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and word beginning of lower-cased texts."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(off, start, "right") - 1
    rows, found = [row], [span_hash(data, start, end)]
    for n in BEGINNINGS:
        long = end - start > n
        rows.append(row[long])
        found.append(span_hash(data, start[long], start[long] + n) ^ U64(n))
    return np.concatenate(rows), np.concatenate(found)


def counts(texts: list[str], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the features that the sorted vocabulary holds."""
    row, h = features(texts)
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    key, n = np.unique(row[hit] * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n.astype(np.float64)


def matrix(texts: list[str], vocabulary: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for at in range(0, len(texts), 200):
        r, c, n = counts(texts[at : at + 200], vocabulary)
        x[at + r, c] = np.log1p(n)
    return x


@dataclass
class Model:
    vocabulary: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        r, c, n = counts(texts, self.vocabulary)
        z = np.bincount(r, self.weight[c] * np.log1p(n), len(texts)) if len(r) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def sentences(texts: list[str], step: int, chars: int = 1 << 21):
    """Every sentence of every text (lines, cut after full stops), `step` at a time or fewer long ones."""
    held, size = [], 0
    for text in texts:
        for line in text.split("\n"):
            for s in line.split(". "):
                if s.strip():
                    held.append(s)
                    size += len(s)
                if len(held) >= step or size >= chars:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def swap_gram(texts: list[str], terms=IDENTITY_TERMS, step: int = 2000) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted features of all terms, sum of d d' over all pairs, number of pairs), where d is how the
    two sentences of a pair differ in these features; they differ in no others.

    A pair is made by a mention and another term of its kind, for every mention of every sentence.
    A sentence without a mention makes two: with one term and another at its end, and without and
    with the one.  These terms are drawn in turn, so each of them comes up.  As only counts matter,
    pairs are not written out: a swap takes the features of one term from a sentence's counts and
    adds those of the other; memory is that of a batch."""
    kinds = sorted(terms)
    flat = [t for k in kinds for t in terms[k]]
    size = np.array([len(terms[k]) for k in kinds])
    start = np.cumsum(size) - size
    tied = np.unique(features([" ".join(flat)])[1])
    own = np.zeros((len(flat), len(tied)))
    r, c, n = counts(flat, tied)
    own[r, c] = n
    word = np.searchsorted(tied, [features([t])[1][0] for t in flat])
    gram, pairs, drawn = np.zeros((len(tied), len(tied))), 0, 0
    for batch in sentences(texts, step):
        held = np.zeros((len(batch), len(tied)))
        r, c, n = counts(batch, tied)
        held[r, c] = n
        mentions = held[:, word]
        for first, most in zip(start, size):
            for i in range(first, first + most):
                rows = np.flatnonzero(mentions[:, i])
                if not len(rows):
                    continue
                times = mentions[rows, i]
                for j in range(first, first + most):
                    if j != i:
                        d = np.log1p(held[rows]) - np.log1p(held[rows] - own[i] + own[j])
                        gram += d.T @ (d * times[:, None])
                        pairs += int(times.sum())
        plain = held[~mentions.any(1)]
        turn = drawn + np.arange(len(plain))
        kind, at = turn % len(kinds), turn // len(kinds)
        a, b = (own[start[kind] + (at + more) % size[kind]] for more in (0, 1))
        for d in (np.log1p(plain + a) - np.log1p(plain + b), np.log1p(plain) - np.log1p(plain + a)):
            gram += d.T @ d
        pairs, drawn = pairs + 2 * len(plain), drawn + len(plain)
    return tied, gram, pairs


def _distinct(texts: list[str], step: int = 200):
    """(row, hash) of the distinct features of each text, some texts at a time."""
    for at in range(0, len(texts), step):
        row, h = features(texts[at : at + step])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
        yield row[first] + at, h[first]


def _gain(df, pos, n1: float, n0: float) -> np.ndarray:
    """How far apart the two classes' shares of documents with a feature are, in standard errors."""
    p1, p0 = (pos + 0.5) / (n1 + 1), (df - pos + 0.5) / (n0 + 1)
    gain = np.abs(p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    gain[df < 4] = 0
    return gain


def fit(rows: list[tuple[int, str, int]], counterfactual: float = 1.0, l2: float = 0.3, terms=IDENTITY_TERMS, steps: int = 300) -> Model:
    y = np.array([r[2] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return Model(np.zeros(0, U64), np.zeros(0), -40.0 if not len(rows) or not y[0] else 40.0)
    texts = [r[1] for r in rows]
    # First pass: document counts of hashed features in 2^20 cells, so that memory is bounded;
    # second pass: exact counts of the features whose cells look telling.
    n1, n0 = y.sum(), (1 - y).sum()
    df, pos = np.zeros(CELLS, np.int32), np.zeros(CELLS, np.int32)
    for row, h in _distinct(texts):
        cell = (h >> U64(44)).astype(np.int64)
        own = np.ones(len(cell), bool)  # a cell counts once a document, however many of its features are in it
        own[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
        cell, row = cell[own], row[own]
        df += np.bincount(cell, minlength=CELLS).astype(np.int32)
        pos += np.bincount(cell[y[row] > 0], minlength=CELLS).astype(np.int32)
    telling = _gain(df, pos, n1, n0) > 2
    found: list[np.ndarray] = []
    for row, h in _distinct(texts):
        on = telling[(h >> U64(44)).astype(np.int64)]
        found.append(np.stack([h[on], (y[row[on]] > 0).astype(U64)]))
    h, one = np.concatenate(found, 1)
    vocabulary, at = np.unique(h, return_inverse=True)
    df, pos = np.bincount(at, minlength=len(vocabulary)), np.bincount(at, one.astype(float), len(vocabulary))
    gain = _gain(df, pos, n1, n0)
    forced, gram, pairs = swap_gram(texts, terms)
    top = np.argsort(-gain, kind="stable")[:FEATURES]
    vocabulary = np.union1d(vocabulary[top[gain[top] > 2.5]], forced)
    x = matrix(texts, vocabulary)
    tied = np.searchsorted(vocabulary, forced)
    w, b = np.zeros(len(vocabulary)), float(np.log(n1 / n0))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):  # Adam on the whole batch
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -40, 40)))
        e = (p - y) / len(y)
        g = x.T @ e.astype(np.float32) + l2 / len(y) * w
        if pairs:
            g[tied] += counterfactual * 2 / pairs * (gram @ w[tied])
        grad = np.concatenate([g, [e.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(vocabulary, w, b)


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = 1.0) -> Model:
    return fit(training_rows(docs, labels, "toxic"), counterfactual)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns of docs with their score, as `name`, over every whole text."""
    keep = docs.columns if keep is None else keep
    slim = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join([*[f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "_score double"])

    def run(batches):
        for b in slices(batches, "_text"):
            s = model.score(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], names=[*[f"_k{i}" for i in range(len(keep))], "_score"])

    out = slim.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_score").alias(name))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
