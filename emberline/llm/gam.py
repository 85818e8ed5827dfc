"""A quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins by quantiles. Boosting goes round and round over the features and adds a
shallow tree of one feature at a time to that feature's lookup table; then over the strongest pairs,
whose tables have two axes. A text's score is the logistic function of the sum of its bins' values.

Null text counts as empty; its features are zeros, and its bins are scored like any other. Repeated rows
each get the same score, an empty table gives an empty table. Without rows that may teach, or with
rows of one label only, every text gets the share of label 1 (1 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.features import NAMES, form
from emberline.llm.labels import held_out, texts_of, training_ids
from emberline.llm.params import GAM_ROWS
from emberline.llm.words import blocks

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 40, 0.1, 4
#: Least rows of a leaf, and the weight of a leaf's pull towards 0.
LEAF_ROWS, RIDGE = 8, 2.0
THRESHOLD = 0.3


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def _value(g, h):
    return g / (h + RIDGE)


def _split(g, h, n):
    """The best cut of neighbouring bins into two leaves: (gain, place) or None."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    allowed = (cn >= LEAF_ROWS) & (n.sum() - cn >= LEAF_ROWS)
    if not allowed.any():
        return None
    gain = cg**2 / (ch + RIDGE) + (g.sum() - cg) ** 2 / (h.sum() - ch + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[~allowed] = -np.inf
    best = int(gain.argmax())
    return (gain[best], best + 1) if gain[best] > 1e-9 else None


def _tree(g, h, n):
    """Values per bin of a tree of at most LEAVES leaves, grown where the gain is largest."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        found = [(s, i) for i, (a, b) in enumerate(leaves) if (s := _split(g[a:b], h[a:b], n[a:b]))]
        if not found:
            break
        (_, place), i = max(found, key=lambda x: x[0][0])
        a, b = leaves.pop(i)
        leaves += [(a, a + place), (a + place, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _square(g, h, n):
    """Values per cell of a tree over two features: a cut, then each side along the other axis.

    The first cut is chosen by what all its leaves gain, as a pure interaction shows only in the second cuts.
    """
    best = (1e-9 + g.sum() ** 2 / (h.sum() + RIDGE), None, None)
    for axis in (0, 1):
        turned = [x if axis == 0 else x.T for x in (g, h, n)]
        for place in range(1, len(turned[0])):
            sides = [[x[side].sum(axis=0) for x in turned] for side in (slice(0, place), slice(place, None))]
            if min(side[2].sum() for side in sides) < LEAF_ROWS:
                continue
            cuts = [_split(*side) for side in sides]
            gain = sum(side[0].sum() ** 2 / (side[1].sum() + RIDGE) + (cut[0] if cut else 0) for side, cut in zip(sides, cuts, strict=True))
            if gain > best[0]:
                best = (gain, axis, (place, [cut and cut[1] for cut in cuts]))
    out = np.zeros_like(g)
    _, axis, found = best
    if found is None:
        return out
    place, cuts = found
    turned = [x if axis == 0 else x.T for x in (g, h, out)]
    for side, cut in zip((slice(0, place), slice(place, None)), cuts, strict=True):
        part = [x[side] for x in turned]
        for columns in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
            part[2][:, columns] = _value(part[0][:, columns].sum(), part[1][:, columns].sum())
    return out


class Model:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = float(y.mean()) if len(y) else 1.0
        self.plain = not 0 < self.constant < 1
        if self.plain:
            return
        self.edges, self.pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
        bins, coarse = _bins(x, self.edges), _bins(x, self.pair_edges)
        self.base = float(np.log(self.constant / (1 - self.constant)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)

        def sums(cell, size):
            p = 1 / (1 + np.exp(-score))
            return (np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size), np.bincount(cell, minlength=size))

        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                if len(table) > 1:
                    step = RATE * _tree(*sums(bins[:, f], len(table)))
                    table += step
                    score += step[bins[:, f]]
        self.pairs = []
        width = PAIR_BINS + 1
        for a in range(x.shape[1]):
            for b in range(a):
                g, h, n = (s.reshape(width, width) for s in sums(coarse[:, a] * width + coarse[:, b], width * width))
                step = _square(g, h, n)
                self.pairs.append((float((g * step - h * step**2 / 2).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(self.pairs, reverse=True)[:PAIRS]]
        self.squares = [np.zeros((width, width)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), square in zip(self.pairs, self.squares, strict=True):
                cell = coarse[:, a] * width + coarse[:, b]
                step = RATE * _square(*(s.reshape(width, width) for s in sums(cell, width * width)))
                square += step
                score += step.ravel()[cell]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.full(len(x), self.constant)
        bins, coarse = _bins(x, self.edges), _bins(x, self.pair_edges)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (a, b), square in zip(self.pairs, self.squares, strict=True):
            total += square[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _forms(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = np.concatenate([form(some) for _, some in blocks(texts)]) if texts else np.zeros((0, len(NAMES)))
        flat = pa.array(rows.ravel())
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32), flat)], ["label", "form"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = GAM_ROWS) -> Model:
    """The model from at most `rows` labelled texts; only their features reach the driver."""
    chosen = texts_of(docs, training_ids(labels, "quality", rows)).orderBy("doc_id").select("label", "text")
    table = chosen.mapInArrow(_forms, "label int, form array<double>").toArrow()
    x = np.array(table["form"].to_pylist(), float).reshape(-1, len(NAMES))
    return Model(x, table["label"].to_numpy().astype(float))


def _scores(model):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parts = [model.value(form(some)) for _, some in blocks(texts)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])
    return run


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(sent), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
