"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import ALNUM, Words, fold, labelled_sample, mix, score_texts, slices

BITS = 18
#: Repetition shares are indicators of "at least 1/2**k of the word pairs (lines) repeat".
LEVELS = 8


def ngram_indicators(texts: list[str]) -> list[np.ndarray]:
    """Sorted feature numbers (below ``2**BITS``) of each text.

    Features: byte trigrams, words and word pairs by hash, and levels of the shares of words that repeat the word before and of
    lines that repeat an earlier line. Every feature is present or absent; the whole text is read. An empty text has none.
    """
    mask = np.uint64(2**BITS - 1)
    words = Words(texts, ALNUM)
    raw = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n\0\0", np.uint8).astype(np.uint64)
    grams = mix((raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:])
    grams = (grams & mask).astype(np.int32)
    h = words.hashes
    pairs = mix(h[:-1] * np.uint64(3) + h[1:]) & mask if len(h) else h
    singles = (h & mask).astype(np.int32)
    pairs = pairs.astype(np.int32)
    same = np.concatenate([[0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1, np.int64)
    found, start = [], 0
    for i, end in enumerate(words.text_ends.tolist()):
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        levels = []
        if b - a > 1:
            levels += _levels(int(same[b - 1] - same[a]), b - a - 1, 0)
        lines = [x for x in texts[i].split("\n") if x]
        if len(lines) > 1:
            levels += _levels(len(lines) - len(set(lines)), len(lines) - 1, 1)
        found.append(np.unique(np.concatenate([grams[start:max(start, end - 3)], singles[a:b], pairs[a:max(a, b - 1)], np.array(levels, np.int32)])))
        start = end
    return found


def _levels(part: int, whole: int, kind: int) -> list[int]:
    codes = [k for k in range(LEVELS) if part * 2**k >= whole and part]
    return [int(mix(np.array([10**6 + kind * 100 + k], np.uint64))[0]) & (2**BITS - 1) for k in codes]


@dataclass
class LinearModel:
    """``weights`` per feature (log-count ratio times learned weight), applied to indicators of unit length."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        """Probability of label 1; a text without features gets the value of the bias alone."""
        margin = self.bias + (float(self.weights[features].sum()) / np.sqrt(len(features)) if len(features) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def fit_nbsvm(features: list[np.ndarray], labels: np.ndarray, penalty: float = 1.0, smooth: float = 1.0, epochs: int = 20, seed: int = 7) -> LinearModel:
    """Log-count ratios of the indicators, then dual coordinate descent on the hinge loss: every multiplier stays between 0 and its class's cost.

    The rarer class is weighted up to balance. With one class only the model returns that class everywhere.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return LinearModel(np.zeros(2**BITS, np.float32), 1.0 if len(y) and y[0] > 0 else -1.0, 2.0, 0.0)
    count = {s: np.full(2**BITS, smooth) for s in (1.0, -1.0)}
    for f, s in zip(features, y, strict=True):
        count[s][f] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    w, bias, alpha = np.zeros(2**BITS), 0.0, np.zeros(len(y))
    cost = {s: penalty * len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    scaled = [ratio[f] / np.sqrt(max(1, len(f))) for f in features]
    norms = np.array([float(x @ x) + 1.0 for x in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, x, s = features[i], scaled[i], y[i]
            gradient = s * (float(w[f] @ x) + bias) - 1
            step = min(max(0.0, alpha[i] - gradient / norms[i]), cost[s]) - alpha[i]
            if step:
                alpha[i] += step
                w[f] += step * s * x
                bias += step * s
    margins = np.array([float(w[f] @ x) + bias for f, x in zip(features, scaled, strict=True)])
    slope, offset = _platt(margins, (y > 0).astype(float))
    return LinearModel((w * ratio).astype(np.float32), bias, slope, offset)


def _platt(margins: np.ndarray, target: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the sigmoid from margin to probability, by damped Newton steps."""
    hits = target.sum()
    goal = np.where(target > 0, (hits + 1) / (hits + 2), 1 / (len(target) - hits + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    v = np.array([2.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        g = x.T @ (p - goal) + 1e-3 * (v - [2.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v = v - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(max(v[0], 0.1)), float(v[1])


def train_quality(docs: DataFrame, labels: DataFrame, where: Column, label: str = "quality", rows: int = 6000) -> LinearModel:
    """Fit on at most ``rows`` labelled texts that ``where`` (on doc_id) allows; features are made by the tasks."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            lists = ngram_indicators(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in lists], pa.binary()), part.column(part.schema.get_field_index("label"))], ["f", "label"]
            )

    sample = labelled_sample(docs, labels, label, rows, where).select("text", "label")
    got = sample.mapInArrow(featurise, "f binary, label int").collect()
    got = sorted((bytes(r["f"]), r["label"]) for r in got)
    return fit_nbsvm([np.frombuffer(f, np.int32) for f, _ in got], np.array([y for _, y in got]))


def score_quality(docs: DataFrame, model: LinearModel, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``column``, a double from 0 to 1 (a column of that name is replaced).

    One pass, no shuffle; a NULL text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.drop(column).withColumn(column, score_texts(lambda texts: np.array([shared.value.score(f) for f in ngram_indicators(texts)])))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from rows outside fold 1 of 3."""
    where = fold(F.col("doc_id"), 3) != 1
    model = train_quality(docs, labels, where, rows=rows)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
