"""A toxicity classifier learnt from toxic and unlabelled texts only.

Non-negative positive-unlabelled learning: with p the share of toxic texts, the risk of calling an
unlabelled text toxic is that over unlabelled texts less p times that over toxic ones. Where the
difference turns negative the model has begun to memorise, and the step goes the other way. The model
is linear in the presence of words (letters and digits, lower case). A first fit, whose penalty leaves most
weights at 0, chooses the words that speak for toxicity; a second one with a slight penalty weighs these alone, as
the first penalty would leave texts with a single such word below the threshold.

Null text counts as empty and scores like a text without known words. Repeated rows each get the same
score, an empty table gives an empty table. Without toxic rows that may teach every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.labels import held_out, texts_of, training_ids, usable_labels
from emberline.llm.params import TOXIC_ROWS, UNLABELLED_ROWS
from emberline.llm.words import NO_LETTER, Runs, blocks, distinct

#: Words that enter the model: met in so many training texts, and so many words at most.
LEAST_TEXTS, WORDS_MOST = 2, 100_000
STEPS, RATE = 400, 0.1
#: Penalties of the fit that chooses words and of the one that weighs them, found on a fold of the rows that may teach.
CHOICE, WEIGHING = 5e-4, 1e-5
THRESHOLD = 0.5


def word_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct word hashes of each text."""
    runs = Runs(texts, NO_LETTER)
    words = runs.hashes()
    return [distinct(words[a:b]) for a, b in zip(runs.first.tolist(), runs.last.tolist(), strict=True)]


class Model:
    """Word hashes with weights other than 0, and the constant."""

    def __init__(self, toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float):
        self.words, self.weights, self.base = np.zeros(0, np.uint64), np.zeros(0), -30.0
        if not len(toxic) or not len(unlabelled):
            return
        sets = [*toxic, *unlabelled]
        words, counts = np.unique(np.concatenate(sets), return_counts=True)
        usual = np.flatnonzero(counts >= LEAST_TEXTS)
        usual = np.sort(usual[np.argsort(-counts[usual], kind="stable")[:WORDS_MOST]])
        words = words[usual]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        column = np.searchsorted(words, flat)
        known = (column < len(words)) & (words[np.minimum(column, max(0, len(words) - 1))] == flat) if len(words) else np.zeros(len(flat), bool)
        row, column = row[known], column[known]
        chosen = self._fit(row, column, len(sets), len(toxic), len(words), prior, CHOICE)[0] > 0
        place, kept = np.cumsum(chosen) - 1, chosen[column]
        weights, self.base = self._fit(
            row[kept], place[column[kept]], len(sets), len(toxic), int(chosen.sum()), prior, WEIGHING)
        used = np.flatnonzero(weights)
        self.words, self.weights = words[chosen][used], weights[used]

    def _fit(self, row, column, n, positive, width, prior, penalty):
        """Weights and constant by proximal Adam on the corrected risk, with the logistic loss."""
        weights, base = np.zeros(width), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
        first, second = np.zeros(width + 1), np.zeros(width + 1)
        toxic = np.arange(n) < positive
        for step in range(1, STEPS + 1):
            margin = np.clip(np.bincount(row, weights[column], n) + base, -30, 30)
            p = 1 / (1 + np.exp(-margin))
            loss = np.logaddexp(0, margin)  # of calling a text harmless
            corrected = loss[~toxic].mean() - prior * loss[toxic].mean()
            harmless = np.where(toxic, -prior / positive, 1 / (n - positive)) * p
            grad = harmless - np.where(toxic, prior / positive, 0.0) * (1 - p) if corrected >= 0 else -harmless
            whole = np.append(np.bincount(column, grad[row], width), grad.sum())
            first = 0.9 * first + 0.1 * whole
            second = 0.999 * second + 0.001 * whole**2
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
            weights, base = weights - move[:-1], base - move[-1]
            shrink = RATE * penalty / (np.sqrt(second[:-1] / (1 - 0.999**step)) + 1e-6)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - shrink, 0)
        return weights, float(base)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(sets), self.base)
        if len(self.words):
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            hit = self.words[at] == flat
            total += np.bincount(np.repeat(np.arange(len(sets)), size)[hit], self.weights[at[hit]], len(sets))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sets(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        packed = [s.tobytes() for _, some in blocks(texts) for s in word_sets(some)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["words"])


def _word_sets(chosen: DataFrame) -> list[np.ndarray]:
    table = chosen.orderBy("doc_id").select("text").mapInArrow(_sets, "words binary").toArrow()
    return [np.frombuffer(w, np.uint64) for w in table["words"].to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
        prior: float | None = None) -> Model:
    """The model from at most so many toxic and unlabelled texts, whose labels are not looked at.

    The class prior is the share of toxic rows among all labelled rows that may teach, unless it is given.
    """
    if prior is None:
        prior = usable_labels(labels, "toxic").agg(F.avg("label").alias("p")).first()["p"]
    if not prior:
        return Model([], [], 0.0)
    toxic = texts_of(docs, training_ids(labels, "toxic", toxic_rows, "label = 1"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(~held_out())
    some = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled_rows).distinct()
    return Model(_word_sets(toxic), _word_sets(texts_of(docs, some)), float(prior))


def _scores(model):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parts = [model.value(word_sets(some)) for _, some in blocks(texts)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])
    return run


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(sent), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
