"""Quality: histogram gradient-boosted trees over statistics of each document.

Trees are grown on quantile bins, then flattened into arrays (feature, threshold, left, right,
value), which numpy walks for a whole batch of documents at once, one level a step.

Defined cases: null and empty texts have zero statistics and are scored like any row; no labelled
rows, or one class only: the score is the share of label 1 (0.5 without rows); repeated rows are
scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lean, slices, span_hash, text_buffer
from quern.llm.learn import held_out, training_rows

_SPACE, _UPPER, _LOWER, _DIGIT, _HIGH = range(1, 6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
NAMES = (
    "bytes words word_length upper digit space high symbol punctuation newlines line_length word_kinds pair_kinds top_word "
    "line_kinds symbol_words upper_words mean_run sentence_words"
).split()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]=+~^_@/\\!"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!;"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:?-'\"()"]] = True


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document of a text buffer.

    Words are runs without white space, lines end at a line feed; kinds of words, pairs of words and
    lines are counted by 64-bit hashes."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(off)
    per = np.maximum(size, 1)
    kind = _CLASS[data]

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[off[1:]] - c[off[:-1]]

    word = kind != _SPACE
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    firsts = off[:-1][size > 0]
    begin[firsts] = word[firsts]
    start = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | begin[1:]
    end = np.flatnonzero(stop) + 1
    code = span_hash(data, start, end)
    at = np.searchsorted(start, off)
    words = np.diff(at)
    some = np.maximum(words, 1)
    line = data == 10
    lines = total(line) + 1
    up, sym = np.concatenate([[0], np.cumsum(kind == _UPPER)]), np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2] = total(word) / some
    for j, k in ((3, _UPPER), (4, _DIGIT), (5, _SPACE), (6, _HIGH)):
        out[:, j] = total(kind == k) / per
    out[:, 7], out[:, 8], out[:, 9] = total(_SYMBOL[data]) / per, total(_PUNCT[data]) / per, total(line) / per
    out[:, 10] = np.log1p(size / lines)
    w = np.concatenate([[0], np.cumsum(sym[end] > sym[start])])
    out[:, 15] = (w[at[1:]] - w[at[:-1]]) / some
    w = np.concatenate([[0], np.cumsum((up[end] - up[start] >= 2) & (up[end] - up[start] >= (end - start) // 2))])
    out[:, 16] = (w[at[1:]] - w[at[:-1]]) / some
    out[:, 18] = np.log1p(words / (total(_STOP[data]) + 1))
    some_text = np.flatnonzero(size)
    cut = np.flatnonzero(line)
    head = np.sort(np.concatenate([off[some_text], cut + 1]), kind="stable")
    tail = np.sort(np.concatenate([off[some_text + 1], cut]), kind="stable")
    line_at = np.concatenate([[0], np.cumsum(np.where(size > 0, lines, 0))])
    line_code = span_hash(data, head, tail)
    pair = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:] if len(code) > 1 else code[:0]
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b > a:
            c = np.sort(code[a:b])
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
            run = np.diff(edge)
            out[i, 11], out[i, 13] = len(run) / (b - a) ** 0.8, run.max() / (b - a)
            if b - a > 1:
                p = np.sort(pair[a : b - 1])
                out[i, 12] = (1 + np.count_nonzero(p[1:] != p[:-1])) / len(p)
        if size[i]:
            own = line_code[line_at[i] : line_at[i + 1]]
            out[i, 14] = len(np.unique(own)) / len(own)
    # longest stretches without a space, on average by their square
    out[:, 17] = np.log1p(np.bincount(np.searchsorted(at, np.arange(len(start)), "right") - 1, (end - start).astype(float) ** 2, n)[:n] / some) if len(start) else 0
    return out


@dataclass
class Forest:
    """All trees in flat arrays; a leaf has left = its own index."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, leaf: float = 8.0, l2: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss on histograms of quantile bins."""
    empty = [np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)]
    if not len(y) or y.min() == y.max():
        return Forest(*empty, 1, 0.0 if not len(y) else (40.0 if y[0] else -40.0))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width = bins + 1
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z = np.full(len(y), np.log(p / (1 - p)))
    bias = float(z[0])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    offsets = np.arange(x.shape[1]) * width
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, hess = q - y, q * (1 - q)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), 0)]
        while open_nodes:
            k, rows, level = open_nodes.pop()
            sg, sh = g[rows].sum(), hess[rows].sum()
            best, where = 1e-6, None
            if level < depth and len(rows) >= 2 * leaf:
                flat = (binned[rows] + offsets).ravel()
                f = x.shape[1]
                hg = np.bincount(flat, np.repeat(g[rows], f), f * width).reshape(f, width).cumsum(1)
                hh = np.bincount(flat, np.repeat(hess[rows], f), f * width).reshape(f, width).cumsum(1)
                hn = np.bincount(flat, minlength=f * width).reshape(f, width).cumsum(1)
                gain = hg**2 / (hh + l2) + (sg - hg) ** 2 / (sh - hh + l2) - sg**2 / (sh + l2)
                gain[(hn < leaf) | (len(rows) - hn < leaf)] = -1
                j, c = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, c] > best and c < len(cuts[j]):
                    where = (int(j), int(c))
            if where is None:
                value[k] = float(-rate * sg / (sh + l2))
                z[rows] += value[k]
                continue
            j, c = where
            a, b = node(), node()
            feature[k], threshold[k], left[k], right[k] = j, float(cuts[j][c]), a, b
            low = binned[rows, j] <= c
            open_nodes += [(a, rows[low], level + 1), (b, rows[~low], level + 1)]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, bias)


def of_texts(texts: list[str]) -> np.ndarray:
    return statistics(*text_buffer(pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()))) if texts else np.zeros((0, len(NAMES)))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    rows = training_rows(docs, labels, "quality")
    x = np.concatenate([of_texts([r[1] for r in rows[i : i + 500]]) for i in range(0, len(rows), 500)]) if rows else np.zeros((0, len(NAMES)))
    return fit(x, np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: Forest, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns of docs with their score, as `name`, over every whole text."""
    keep = docs.columns if keep is None else keep
    slim = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join([*[f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "_score double"])

    def run(batches):
        for b in slices(batches, "_text"):
            s = model.score(statistics(*text_buffer(b.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], names=[*[f"_k{i}" for i in range(len(keep))], "_score"])

    out = slim.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_score").alias(name))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
