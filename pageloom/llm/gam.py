"""Quality classifier: a generalised additive model with pairwise interactions.

A text's score is the logistic of a sum of table entries: one table per feature, indexed by the
feature's bin, and one per chosen pair of features. The tables are learned by cyclic boosting: the
features take turns, and each turn adds a shallow tree on that feature alone (at most three leaves,
two bins cuts for each feature of a pair), damped by the learning rate. Trees on one feature sum to
a lookup table, so scoring is binning and adding.

The fit uses at most ``max_rows`` labelled rows, those whose ids come first in a hash order; that is
the only bound, and everything else sees all rows. Features come from the text alone.

Cases: a NULL text is scored as the empty one; ids with several labels count once with the greatest;
of repeated ids in the documents the row with the least features is learned from; NULL labels are left
out; without labelled rows, or with one class, the score is the smoothed share of label 1. An empty
table gives no rows. Other columns pass through; ``score`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm import batches as bt

FEATURES = [
    "log_bytes", "upper", "digits", "bars", "shouts", "symbols", "stops", "non_ascii", "word_bytes", "distinct",
    "repeats", "top_word", "titles", "breaks", "single", "symbol_ends",
]


def _bytes_in(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_UPPER, _LOWER = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes(range(97, 123)))
_DIGIT, _SYMBOL = _bytes_in(b"0123456789"), _bytes_in(b"#$%&*+<=>@[\\]^_`{}~")
_STOP, _HIGH = _bytes_in(b".,;:?"), np.arange(256) >= 128


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES``; shares are per letter or per word, all 0 for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    seen = Counter(words)
    ends = sum(not chr(w[-1]).isalnum() and w[-1] < 128 and w[-1] not in b".,;:?" for w in words)
    return [
        float(np.log1p(len(data))),
        upper / max(upper + lower, 1),
        int(counts[_DIGIT].sum()) / len(data),
        int(counts[ord("|")]) / n,
        int(counts[ord("!")]) / n,
        int(counts[_SYMBOL].sum()) / n,
        int(counts[_STOP].sum()) / n,
        int(counts[_HIGH].sum()) / len(data),
        sum(map(len, words)) / n,
        len(seen) / n**0.8,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(seen.values()) / n,
        sum(w[:1].isupper() for w in words) / n,
        int(counts[10]) / n,
        sum(len(w) == 1 for w in words) / n,
        ends / n,
    ]


def _matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` maps two features to coarse edges and a table."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), (a, b, table) in self.pairs.items():
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, near the quantiles."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.empty(0)
    middles = (distinct[1:] + distinct[:-1]) / 2
    wanted = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])
    return np.unique(middles[np.minimum(np.searchsorted(middles, wanted), len(middles) - 1)])


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, c) of the split into bins below c and from c on."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    c = int(np.argmax(gain))
    return float(gain[c]), c + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values per bin of a tree with up to three leaves."""
    _, first = _best_cut(g, h, ridge)
    leaves = [(0, first), (first, len(g))] if first else [(0, len(g))]
    options = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in leaves]
    gain, cut, a, b = max(options)
    if gain > 1e-9:
        leaves.remove((a, b))
        leaves += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts both features of a pair once."""
    best, values = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + ridge)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            parts = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            sums = [(g[p].sum(), h[p].sum()) for p in parts]
            gain = sum(x * x / (y + ridge) for x, y in sums) - base
            if gain > best + 1e-9:
                best, values = gain, np.zeros_like(g)
                for p, (x, y) in zip(parts, sums):
                    values[p] = x / (y + ridge)
    return best, values


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 4, pair_bins: int = 8,
    pair_rounds: int = 30, rate: float = 0.15, ridge: float = 1.0,
) -> Model:
    """Cyclic boosting on the logistic loss; deterministic."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    placed = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            if len(model.edges[j]):
                g, h = slopes()
                size = len(model.tables[j])
                step = rate * _tree(np.bincount(placed[j], g, size), np.bincount(placed[j], h, size), ridge)
                model.tables[j] += step
                total += step[placed[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(k)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell, (g, h) = at[i] * shape[1] + at[j], slopes()
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    usable = [j for j in range(k) if len(coarse[j])]
    gains = sorted(((-_quadrants(*grids(i, j), ridge)[0], i, j) for i, j in combinations(usable, 2)))
    chosen = [(i, j) for _, i, j in gains[:n_pairs]]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            step = rate * _quadrants(*grids(i, j), ridge)[1]
            tables[i, j] += step
            total += step[at[i], at[j]]
    model.pairs = {(i, j): (coarse[i], coarse[j], tables[i, j]) for i, j in chosen}
    return model


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """The id's fold, by the CRC32 of its decimal text; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 20000) -> Model:
    """Fit on the labelled rows given; the caller leaves out what is held out."""
    once = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    drawn = bt.first_by_hash(once, ["id"], max_rows, once.count())
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(drawn), "id")  # at most max_rows ids
    measured = bt.add_columns(texts, "text", {"x": "array<double>"}, lambda t: [pa.array(list(_matrix(t)), pa.list_(pa.float64()))])
    rows = sorted(measured.groupBy("id", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; row-local."""
    return bt.add_columns(docs, text, {"score": "double"}, lambda t: [pa.array(model.score(_matrix(t)))])
