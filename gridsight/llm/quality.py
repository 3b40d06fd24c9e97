"""Quality by a factorisation machine (operator 10).

Inputs are statistics of a text's structure, its length, and its words hashed into buckets; every pair of inputs also
has an effect, the product of their values and of two low-rank vectors. The sum over all pairs is half of the square of
sums less the sum of squares, factor by factor, so a document is scored in time linear in its inputs.

The model is fitted on the driver from a bounded sample of labelled documents whose inputs tasks have computed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample

#: Labelled documents the model is fitted on at most, and characters of all of them; the document that crosses is whole.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 128_000_000
FOLDS, HELD = 4, 2
BUCKETS = 1024
FACTORS = 6
STEPS, RATE, DECAY = 200, 0.03, 1e-4
THRESHOLD = 0.7
KNOWN_WORDS = 400_000
DOCS_TOGETHER = 256

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b"?.,;:", b"\n", b"(){}[]=_/\\+@")
_CLASS_OF = np.zeros((256, len(_CLASSES) + 1))
for _place, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes), _place] = 1.0
_CLASS_OF[128:, -1] = 1.0
STATISTICS = len(_CLASSES) + 1 + 9


class WordHashes(dict):
    """Hash of each word met so far."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode())
        if len(self) > KNOWN_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def inputs_of(text: str, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Structure statistics of a text, and its words as weights of buckets with a square sum of one."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    found = text.lower().split()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n_words, n_bytes = len(found), max(len(data), 1)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    repeated = 0.0
    if n_words > 2:
        triples = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
        repeated = 1.0 - len(np.unique(triples)) / len(triples)
    stats = np.concatenate([
        counts @ _CLASS_OF / n_bytes,
        [
            np.log1p(n_words), np.log1p(len(text)), len(text) / max(n_words, 1), len(np.unique(hashes)) / max(n_words, 1),
            repeated, 1.0 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)),
            n_words / max(len(lines), 1) / 100.0, float(n_words < 50),
        ],
    ])
    bag = np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(float)
    return stats, bag / max(np.sqrt((bag * bag).sum()), 1.0)


@dataclass
class Model:
    """Scaling of the statistics, and bias, weights and factors of all inputs."""

    middle: np.ndarray
    spread: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def matrix(self, stats: np.ndarray, bags: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.middle) / self.spread, -4.0, 4.0) / 2.0
        return np.hstack([scaled, bags])

    def scores(self, stats: np.ndarray, bags: np.ndarray) -> np.ndarray:
        inputs = self.matrix(stats, bags)
        return 1.0 / (1.0 + np.exp(-np.clip(log_odds(inputs, self.bias, self.weights, self.factors), -500, 500)))


def log_odds(inputs: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Bias, linear part and pairs; the pairs by the sum-of-squares identity."""
    sums = inputs @ factors
    return bias + inputs @ weights + 0.5 * (sums * sums - (inputs * inputs) @ (factors * factors)).sum(axis=1)


def fit(labels: np.ndarray, stats: np.ndarray, bags: np.ndarray) -> Model:
    """The model of a sample; without labels of both kinds every document scores alike."""
    size = STATISTICS + BUCKETS
    if not len(labels) or labels.min() == labels.max():
        bias = 0.0 if not len(labels) else (5.0 if labels[0] else -5.0)
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), bias, np.zeros(size), np.zeros((size, FACTORS)))
    model = Model(stats.mean(axis=0), stats.std(axis=0) + 1e-6, 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    inputs = model.matrix(stats, bags)
    squares = inputs * inputs
    state = np.random.default_rng(7).normal(0.0, 0.02, (size + 1, FACTORS + 1))
    state[:, 0] = 0.0  # first column: weights, and the bias in the last row
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        factors = state[:-1, 1:]
        sums = inputs @ factors
        odds = state[-1, 0] + inputs @ state[:-1, 0] + 0.5 * (sums * sums - squares @ (factors * factors)).sum(axis=1)
        error = (1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))) - labels) / len(labels)
        change = DECAY * state
        change[-1] = 0.0
        change[-1, 0] = error.sum()
        change[:-1, 0] += inputs.T @ error
        change[:-1, 1:] += inputs.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * factors
        first = 0.9 * first + 0.1 * change
        second = 0.999 * second + 0.001 * change * change
        state -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(model.middle, model.spread, float(state[-1, 0]), state[:-1, 0].copy(), state[:-1, 1:].copy())


def _inputs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for rows in frames:
        both = [inputs_of(text, words) for text in rows["text"]]
        out = [(int(label), stats.tobytes(), bag.astype("<f4").tobytes()) for label, (stats, bag) in zip(rows["label"], both)]
        yield pd.DataFrame(out, columns=["label", "stats", "bag"])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of a table of documents and their labels."""
    rows = sample(docs, labels, label, FOLDS, HELD, SAMPLE_ROWS, SAMPLE_CHARS)
    found = sorted(map(tuple, rows.select("label", "text").mapInPandas(_inputs, "label int, stats binary, bag binary").collect()))
    stats = np.array([np.frombuffer(row[1]) for row in found]).reshape(len(found), STATISTICS)
    bags = np.array([np.frombuffer(row[2], "<f4") for row in found], float).reshape(len(found), BUCKETS)
    return fit(np.array([row[0] for row in found], float), stats, bags)


def quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of the table: doc_id and score.

    A null text counts as empty; an empty one is scored from its statistics; texts are used whole, however long. Repeated rows are scored each, a null id
    stays null, an empty table gives an empty one. Other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for rows in frames:
            texts, doc_ids = rows["text"].tolist(), rows["doc_id"].astype("Int64")
            for start in range(0, len(texts), DOCS_TOGETHER):
                both = [inputs_of(text, words) for text in texts[start : start + DOCS_TOGETHER]]
                scores = model.scores(np.array([stats for stats, _ in both]), np.array([bag for _, bag in both]))
                yield pd.DataFrame({"doc_id": doc_ids[start : start + DOCS_TOGETHER].array, "score": scores})

    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text).mapInPandas(run, "doc_id bigint, score double")


def document_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents with the verdict, from a model fitted on labelled ones outside the held-out fold."""
    scored = quality(docs, fitted(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
