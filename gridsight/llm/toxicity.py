"""Toxicity by multiple-instance learning (operator 6).

Only documents are labelled, but single sentences make them toxic. A document is toxic unless all its sentences are clean:
the noisy-or 1 - (1 - leak) * prod(1 - p). A sentence has a probability from the hashed words and word beginnings that
tell toxic documents from clean ones: 1 - p = (1 - s(bias + z)) / (1 - s(bias)) with s the logistic function and z the sum
of their weights, none below zero. A sentence without any has p = 0; what such sentences leave unexplained is the leak,
one per document. The model is fitted to document labels through that formula, and the sentences with a high probability
of their own are the ones that offend.

Words of toxic documents turn up in clean ones too, the more the longer a text is. ``chance`` is what a sentence of a clean
document adds to -log(prod(1 - p)) on average; ``SPREAD`` times that for each sentence is taken off a document's sum, so that
length alone makes no document toxic. A scale and a shift of the log-odds, fitted on a part of the sample that is kept
apart while they are, put one half where a document is as likely toxic as not.

Fitting: tasks count in how many toxic and clean documents of a bounded sample each feature occurs; those that occur more
often in toxic ones than chance allows are kept, at most ``KEPT``. Tasks then cut each document down to the kept features
of its sentences, equal sentences once with their number, and the driver fits weights by full-batch gradient steps.
Scoring: a word's weight is the sum over its features, kept in a dictionary of bounded size per worker.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample

#: Labelled documents the model is fitted on at most, and characters of all of them; the document that crosses is whole.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 128_000_000
FOLDS, HELD = 5, 0
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
KEPT = 1024
LEAST_DOCUMENTS = 4
LEAST_GAIN = 4.0
STEPS, RATE, DECAY, SHRINK = 300, 0.1, 1e-4, 2e-5
LEAST_WEIGHT, MOST_BIAS = 0.1, -4.0
#: Times the sum that chance makes of a text's sentences that is taken off; one document in ``APART`` is kept apart.
SPREAD, APART, LEAST_APART = 2.0, 4, 5
KNOWN_WORDS = 400_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def spans(text: str) -> list[tuple[int, int]]:
    """Where sentences start and end; they are parted by stops and line ends."""
    return [found.span() for found in _SENTENCE.finditer(text) if not found.group().isspace()]


def features(word: str) -> list[int]:
    """Buckets of a lower-case word and of its beginnings; a word without letters or digits has none."""
    word = _EDGE.sub("", word)
    if not word:
        return []
    whole = zlib.crc32(("=" + word).encode()) % BUCKETS
    return [whole, *[zlib.crc32(("^" + word[:size]).encode()) % BUCKETS for size in PREFIXES if len(word) >= size]]


@dataclass
class Model:
    """Weights of the kept buckets, the bias of a sentence that has any, the log-odds of the leak of a document, what chance
    adds per sentence, and scale and shift of a document's log-odds."""

    weights: dict[int, float]
    bias: float
    leak: float
    chance: float = 0.0
    scale: float = 1.0
    shift: float = 0.0


class WordFeatures(dict):
    """Buckets of each word met so far."""

    def __missing__(self, word: str) -> list[int]:
        found = features(word)
        if len(self) > KNOWN_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class WordWeights(dict):
    """Weight of each word met so far."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: str) -> float:
        weight = sum(self.weights.get(bucket, 0.0) for bucket in set(features(word)))
        if len(self) > KNOWN_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = weight
        return weight


def sentences(low: str) -> Iterator[str]:
    """The sentences of a text."""
    return (found.group() for found in _SENTENCE.finditer(low) if not found.group().isspace())


def sentence_scores(text: str, words: WordWeights, bias: float) -> np.ndarray:
    """Log-odds of each sentence, minus infinity without a kept feature; a text without sentences has one such."""
    weigh = words.__getitem__
    sums = np.array([sum(map(weigh, part.split())) for part in sentences(text.lower())] or [0.0], float)
    with np.errstate(divide="ignore", over="ignore"):
        return bias - np.logaddexp(0.0, bias) + np.where(sums > 30.0, sums, np.log(np.expm1(np.minimum(sums, 30.0))))


def noisy_or(log_odds: np.ndarray, leak: float = -np.inf) -> float:
    """Probability that at least one sentence is toxic, or the document without one."""
    return float(-np.expm1(-np.logaddexp(0.0, log_odds).sum() - np.logaddexp(0.0, leak)))


def log_odds_of(sums: np.ndarray) -> np.ndarray:
    """Log-odds of documents whose -log(prod(1 - p)) is given."""
    return np.where(sums > 30.0, sums, np.log(np.expm1(np.clip(sums, 1e-9, 30.0))))


def discounted(sums: np.ndarray, count: np.ndarray, leak: float, chance: float) -> np.ndarray:
    """Sums of documents less what chance makes of their sentences, not below the leak alone."""
    return np.logaddexp(0.0, leak) + np.maximum(sums - SPREAD * chance * count, 0.0)


def score_of(log_odds: np.ndarray, model: Model) -> float:
    """Score of a document from the log-odds of its sentences."""
    total = discounted(np.logaddexp(0.0, log_odds).sum(), np.array(len(log_odds)), model.leak, model.chance)
    return float(1.0 / (1.0 + np.exp(-(model.scale * np.clip(log_odds_of(total), -30.0, 30.0) + model.shift))))


def document_score(text: str, words: WordWeights, model: Model) -> float:
    """Score of a text."""
    return score_of(sentence_scores(text, words, model.bias), model)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents of a task, and how many toxic ones, each bucket occurs."""
    words = WordFeatures()
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for rows in frames:
        for label, text in zip(rows["label"], rows["text"]):
            # word by word: the list of all words of a long text would take many times its size
            found = {bucket for part in sentences(text.lower()) for word in part.split() for bucket in words[word]}
            places = np.fromiter(found, np.int64, len(found))
            seen[places] += 1
            toxic[places] += int(label > 0)
    met = np.flatnonzero(seen)
    yield pd.DataFrame({"bucket": met, "seen": seen[met], "toxic": toxic[met]})


def screened(rows: DataFrame, share: float) -> list[int]:
    """Buckets that occur in toxic documents more often than their share, the most telling first."""
    counts = rows.select("label", "text").mapInPandas(_counted, "bucket long, seen long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    counts = counts.where((F.col("seen") >= LEAST_DOCUMENTS) & (F.col("toxic") > F.col("seen") * share))
    clean = F.col("seen") - F.col("toxic")
    gain = F.col("toxic") * F.log(F.col("toxic") / (F.col("seen") * share))
    gain = gain + F.when(clean > 0, clean * F.log(clean / (F.col("seen") * (1 - share)))).otherwise(0.0)
    best = counts.select("bucket", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "bucket")
    return [row["bucket"] for row in best.limit(KEPT).collect()]


def _reduced(kept: list[int]):
    column = {bucket: place for place, bucket in enumerate(kept)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordFeatures()
        for rows in frames:
            out = []
            for label, text in zip(rows["label"], rows["text"]):
                alike, count = Counter(), 0
                for part in sentences(text.lower()):
                    count += 1
                    found = frozenset(column[b] for word in part.split() for b in words[word] if b in column)
                    if found:
                        alike[tuple(sorted(found))] += 1
                ordered = sorted(alike.items())
                arrays = ([len(one) for one, _ in ordered], [c for one, _ in ordered for c in one], [times for _, times in ordered])
                out.append((int(label > 0), max(count, 1), *(np.array(one, "<i4").tobytes() for one in arrays)))
            yield pd.DataFrame(out, columns=["label", "sentences", "sizes", "columns", "times"])

    return run


Arrays = list[np.ndarray]


def fit(kept: list[int], labels: np.ndarray, counts: np.ndarray, sizes: Arrays, columns: Arrays, times: Arrays) -> tuple[np.ndarray, float]:
    """Weights of the kept features, bias and leak in one array, and what chance adds per sentence.

    Given are per document its label and number of sentences, and of its sentences with kept features their number of
    features, the features as places in ``kept``, and how often each sentence occurs.
    """
    labels_ = labels.astype(float)
    sentence_doc = np.repeat(np.arange(len(labels)), [len(one) for one in sizes])
    entry_sentence = np.repeat(np.arange(len(sentence_doc)), np.concatenate(sizes))
    column, often = np.concatenate(columns), np.concatenate(times).astype(float)

    values = np.ones(len(kept) + 2)  # the last two are the bias and the leak
    values[-2:] = MOST_BIAS, -4.0
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        bias, leak = values[-2:]
        odds = bias + np.bincount(entry_sentence, weights=values[column], minlength=len(sentence_doc))
        above = often * (np.logaddexp(0.0, odds) - np.logaddexp(0.0, bias))
        total = np.logaddexp(0.0, leak) + np.bincount(sentence_doc, weights=above, minlength=len(labels))
        outer = np.where(labels_ > 0, -1.0 / np.maximum(np.expm1(np.minimum(total, 50.0)), 1e-6), 1.0) / len(labels)
        slope, dirty = outer[sentence_doc] * often, 1.0 / (1.0 + np.exp(-odds))
        change = np.append(
            np.bincount(column, weights=(slope * dirty)[entry_sentence], minlength=len(kept)),
            [(slope * (dirty - 1.0 / (1.0 + np.exp(-bias)))).sum(), outer.sum() / (1.0 + np.exp(-leak))],
        )
        change[:-2] += DECAY * values[:-2] + SHRINK
        first = 0.9 * first + 0.1 * change
        second = 0.999 * second + 0.001 * change * change
        values -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        values[:-2], values[-2] = np.maximum(values[:-2], 0.0), min(values[-2], MOST_BIAS)
    values[:-2] = np.where(values[:-2] >= LEAST_WEIGHT, values[:-2], 0.0)
    clean = labels_ == 0
    sums = sums_of(values, len(labels), sizes, columns, times)
    return values, float(sums[clean].sum() / max(counts[clean].sum(), 1))


def sums_of(values: np.ndarray, documents: int, sizes: Arrays, columns: Arrays, times: Arrays) -> np.ndarray:
    """What the sentences of each document add to -log(prod(1 - p)); arrays as in ``fit``."""
    sentence_doc = np.repeat(np.arange(documents), [len(one) for one in sizes])
    entry_sentence = np.repeat(np.arange(len(sentence_doc)), np.concatenate(sizes))
    weights = np.bincount(entry_sentence, weights=values[np.concatenate(columns)], minlength=len(sentence_doc))
    above = np.logaddexp(0.0, values[-2] + weights) - np.logaddexp(0.0, values[-2])
    return np.bincount(sentence_doc, weights=np.concatenate(times) * above, minlength=documents)


def calibrated(log_odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log-odds by Newton steps, held near 1 and 0 where there is little to go by."""
    values = np.array([1.0, 0.0])
    inputs = np.stack([np.clip(log_odds, -30.0, 30.0), np.ones(len(labels))])
    for _ in range(50):
        likely = 1.0 / (1.0 + np.exp(-np.clip(values @ inputs, -500, 500)))
        change = inputs @ (likely - labels) + (values - [1.0, 0.0])
        curve = (inputs * (likely * (1 - likely))) @ inputs.T + np.eye(2)
        values = values - np.linalg.solve(curve, change)
    return float(np.clip(values[0], 0.25, 4.0)), float(np.clip(values[1], -8.0, 8.0))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of a table of documents and their labels; without a toxic and a clean document all score alike."""
    rows = sample(docs, labels, label, FOLDS, HELD, SAMPLE_ROWS, SAMPLE_CHARS)
    size, dirty = rows.agg(F.count(F.lit(1)), F.sum((F.col("label") > 0).cast("int"))).first()
    if not size or not 0 < dirty < size:
        return Model({}, MOST_BIAS, 5.0 if dirty else -9.0)
    kept = screened(rows, dirty / size)
    schema = "label int, sentences int, sizes binary, columns binary, times binary"
    # sorted: float sums depend on the order of the sample
    found = sorted(map(tuple, rows.select("label", "text").mapInPandas(_reduced(kept), schema).collect()))
    labels_, counts = (np.array([row[at] for row in found]) for at in (0, 1))
    arrays = [[np.frombuffer(row[at], "<i4") for row in found] for at in (2, 3, 4)]
    values, chance = fit(kept, labels_, counts, *arrays)
    model = Model({bucket: float(weight) for bucket, weight in zip(kept, values) if weight}, float(values[-2]), float(values[-1]), chance)
    # equal documents are neighbours: every APART-th is kept apart, and the scale fitted on it with weights of the others
    apart = np.arange(len(found)) % APART == 0
    if min(labels_[apart].sum(), (1 - labels_[apart]).sum()) >= LEAST_APART:
        rest, own = ([[one for one, held in zip(part, apart) if held == side] for part in arrays] for side in (False, True))
        values, chance = fit(kept, labels_[~apart], counts[~apart], *rest)
        sums = discounted(sums_of(values, int(apart.sum()), *own), counts[apart], float(values[-1]), chance)
        model.scale, model.shift = calibrated(log_odds_of(sums), labels_[apart])
    return model


SCORED = "score double, sentences int, worst int, worst_start int, worst_end int, worst_score double, offending array<int>"


def _scored(model: Model, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordWeights(model)
        for rows in frames:
            out = []
            for text in rows["__text"]:
                odds = sentence_scores(text, words, model.bias)
                worst = int(odds.argmax())
                places = spans(text)
                start, end = places[worst] if places else (0, 0)
                dirty = 1.0 / (1.0 + np.exp(-odds))
                offending = np.flatnonzero(odds >= 0).tolist()
                out.append((score_of(odds, model), len(places), worst, start, end, float(dirty[worst]), offending))
            made = pd.DataFrame(out, columns=[part.split()[0] for part in SCORED.split(", ")], index=rows.index)
            yield pd.concat([rows[columns], made], axis=1)

    return run


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of the table: doc_id, score, sentences, and which sentences offend.

    ``worst`` is the sentence with the highest probability, with its place in the text in characters; ``offending`` lists
    those at one half or more. A null or empty text has no sentence and the score of the leak; texts are used whole, however long. Repeated rows are
    scored each, a null id stays null, an empty table gives an empty one. Other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text)
    return rows.mapInPandas(_nullable(_scored(model, ["doc_id"])), "doc_id bigint, " + SCORED)


def _nullable(run):
    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(rows.astype({"doc_id": "Int64"}) for rows in frames)

    return typed


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below a threshold; columns as they were. Every row of a text gets the same verdict."""
    scores = F.pandas_udf(_text_scores(fitted(docs, labels)), "double")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(scores(text) < threshold)


def _text_scores(model: Model):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = WordWeights(model)
        for texts in batches:
            yield pd.Series([document_score(text, words, model) for text in texts], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return score


def document_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents with the verdict, from a model fitted on labelled ones outside the held-out fold."""
    scored = toxicity(docs, fitted(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences", "worst", "worst_start", "worst_end", "offending",
    )
