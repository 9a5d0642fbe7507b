"""Toxicity: a convolutional classifier over hashed word embeddings, trained in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.blocks import filtered, id_filter
from panelmill.llm.common import ALNUM, Words, fold, known_labels, labelled_sample, score_texts, slices
from panelmill.session import cut_lineage

BITS = 18
#: A word is embedded as the sum of the rows of its own hash and of the hashes of its first 5 and 6 bytes.
HEADS = (5, 6)
WIDTHS = (1, 2, 3)
PAD = 2**BITS


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words (one line of 1 + len(HEADS) numbers each) and the bounds of the texts.

    Every text ends with max(WIDTHS) padding words, so windows never span two texts and an empty text has windows, too.
    """
    words = Words(texts, ALNUM)
    mask = np.uint64(2**BITS - 1)
    rows = np.stack([words.hashes & mask, *[words.heads(n) * np.uint64(2 * n + 1) & mask for n in HEADS]], 1).astype(np.int32)
    pad = max(WIDTHS)
    counts = np.diff(words.bounds)
    bounds = np.concatenate([[0], np.cumsum(counts + pad)]).astype(np.int64)
    out = np.full((int(bounds[-1]), rows.shape[1]), PAD, np.int32)
    out[np.arange(len(rows)) + pad * np.repeat(np.arange(len(counts)), counts)] = rows
    return out, bounds


@dataclass
class ConvModel:
    """Embedding (the last row is padding and stays zero), filters per width, output weights; thresholds by language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def responses(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded words and the filter responses at every window start; windows that pass the end of a text are low."""
        x = self.embedding[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x = x + self.embedding[rows[:, j]]
        parts = []
        for w in self.filters:
            r = x @ w[0]
            for o in range(1, len(w)):
                r[:-o] += x[o:] @ w[o]
            parts.append(r)
        out = np.concatenate(parts, 1)
        last = bounds[1:]
        for o in range(1, max(WIDTHS)):
            out[last - o] = -1e9
        return x, out

    def scores(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        _, r = self.responses(rows, bounds)
        pooled = np.maximum.reduceat(r, bounds[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(np.tanh(pooled).astype(float) @ self.output + self.bias, -50, 50)))


def fit_conv(docs: list[np.ndarray], labels: np.ndarray, dims: int = 8, filters: int = 8, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 5) -> ConvModel:
    """Adagrad on the logistic loss. ``docs``: word rows of each text, padded.

    Max pooling passes a gradient to one window only, so the first dimension of the embedding starts at the smoothed log-odds
    of the classes among texts that hold the row; the others start small and random. Classes are balanced by weight.
    With one class only the model returns that class everywhere.
    """
    rng = np.random.default_rng(seed)
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    e = rng.normal(0, 0.05, (PAD + 1, dims)).astype(np.float32)
    w = [rng.normal(0, 0.1, (k, dims, filters)).astype(np.float32) for k in WIDTHS]
    output = rng.normal(0, 0.1, filters * len(WIDTHS))
    if not n1 or not n0:
        return ConvModel(e, w, output * 0, 4.0 if n1 else -4.0)
    seen = {0: np.zeros(PAD + 1), 1: np.zeros(PAD + 1)}
    for d, y in zip(docs, labels, strict=True):
        seen[int(y)][np.unique(d)] += 1
    prior = 2.0 * np.array([n0, n1]) / len(labels)
    odds = np.log((seen[1] + prior[1]) / (n1 + prior.sum())) - np.log((seen[0] + prior[0]) / (n0 + prior.sum()))
    e[:, 0] = np.clip(odds / 6, -1, 1)
    e[PAD] = 0
    for k in w:
        k[0, 0] += 1.0
    output += 0.5
    model = ConvModel(e, w, output, -1.0)
    cost = np.where(labels > 0, len(labels) / (2 * n1), len(labels) / (2 * n0))
    g_e, g_w, g_o, g_b = np.full(PAD + 1, 1e-2, np.float32), [np.full_like(k, 1e-2) for k in w], np.full_like(output, 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            part = [docs[i] for i in ids]
            bounds = np.concatenate([[0], np.cumsum([len(d) for d in part])]).astype(np.int64)
            rows = np.concatenate(part)
            x, r = model.responses(rows, bounds)
            top = np.stack([a + r[a:b].argmax(0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            pooled = np.tanh(r[top, np.arange(r.shape[1])].astype(float))
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.output + model.bias, -50, 50)))
            error = (p - labels[ids]) * cost[ids] / len(ids)
            d_out, d_pool = error @ pooled, (error[:, None] * model.output) * (1 - pooled**2)
            g_o += d_out**2
            model.output -= rate * d_out / np.sqrt(g_o)
            g_b += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(g_b)
            touched, gradients = [], []
            for k, kernel in enumerate(w):
                spots, d = top[:, k * filters : (k + 1) * filters], d_pool[:, k * filters : (k + 1) * filters].astype(np.float32)
                for o in range(len(kernel)):
                    near = x[spots + o]
                    touched.append((spots + o).ravel())
                    gradients.append((d[:, :, None] * kernel[o].T[None]).reshape(-1, dims))
                    step = np.einsum("bfd,bf->df", near, d)
                    g_w[k][o] += step**2
                    kernel[o] -= rate * step / np.sqrt(g_w[k][o])
            spots, gradients = np.concatenate(touched), np.concatenate(gradients)
            for j in range(rows.shape[1]):
                used, where = np.unique(rows[spots, j], return_inverse=True)
                total = np.zeros((len(used), dims), np.float32)
                np.add.at(total, where, gradients)
                g_e[used] += (total**2).mean(1)
                e[used] -= rate * total / np.sqrt(g_e[used])[:, None]
            e[PAD] = 0
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the cut that makes the fewest errors (ties: nearest to 0.5); 0.5 if one class is missing."""
    if not len(labels) or labels.min() == labels.max():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    errors = np.concatenate([[y.sum()], y.sum() - np.cumsum(y) + np.cumsum(1 - y)])
    cuts = np.concatenate([[1.0], (s[:-1] + s[1:]) / 2, [0.0]])
    real = np.concatenate([[True], s[:-1] > s[1:], [True]])
    best = np.flatnonzero(real & (errors == errors[real].min()))
    return float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])


#: Score bins of the calibration. Each bin knows its lowest and highest score, so cuts between bins are exact.
BINS = 4096


def cut_of_bins(low: np.ndarray, high: np.ndarray, n: np.ndarray, positive: np.ndarray) -> float:
    """``best_threshold`` from the lowest and highest score, rows and rows of label 1 of each bin; bins are not split."""
    if not positive.sum() or positive.sum() == n.sum():
        return 0.5
    order = np.argsort(-low, kind="stable")
    low, high, n, positive = low[order], high[order], n[order], positive[order]
    errors = positive.sum() + np.concatenate([[0], np.cumsum(n - 2 * positive)])
    cuts = np.concatenate([[1.0], (low[:-1] + high[1:]) / 2, [0.0]])
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])


def calibrate(model: ConvModel, docs: DataFrame, known: DataFrame, trained: DataFrame, least: int) -> None:
    """Set the common threshold and those of languages with at least ``least`` texts of either class, from all labelled texts not in ``trained``.

    ``docs``: doc_id, text, lang; ``known``: doc_id, label. Texts are scored where they lie; scores and counts per (language, bin) are what travels.
    The driver gets at most ``BINS`` rows a language.
    """
    known = cut_lineage(known.join(F.broadcast(trained), "doc_id", "left_anti"))
    texts = filtered(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", id_filter(known.select(F.col("doc_id").cast("long"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            scores = shared.value.scores(*word_rows(texts))
            rest = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], ["doc_id", "lang", "score"])

    scored = texts.mapInArrow(score, "doc_id long, lang string, score double").join(known, "doc_id")
    place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1))
    counts = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("positive").alias("positive")]
    rows = scored.select(
        F.coalesce("lang", F.lit("")).alias("lang"), place.alias("bin"), F.col("score").alias("low"), F.col("score").alias("high"),
        F.lit(1).alias("n"), F.col("label").alias("positive"),
    )
    bins = cut_lineage(rows.groupBy("lang", "bin").agg(*counts))
    totals = bins.groupBy("lang").agg(F.sum("positive").alias("_positive"), F.sum("n").alias("_n"))
    enough = totals.where((F.col("_positive") >= least) & (F.col("_n") - F.col("_positive") >= least)).select("lang")

    def columns(part: list) -> list[np.ndarray]:
        return [np.array([r[c] for r in part]) for c in ("low", "high", "n", "positive")]

    model.threshold = cut_of_bins(*columns(bins.groupBy("bin").agg(*counts).collect()))
    own = bins.join(enough, "lang").collect()
    for name in {r["lang"] for r in own}:
        model.thresholds[name] = cut_of_bins(*columns([r for r in own if r["lang"] == name]))


def train_toxicity(docs: DataFrame, labels: DataFrame, where: Column, label: str = "toxic", rows: int = 6000, least: int = 30) -> ConvModel:
    """Fit on at most ``rows`` labelled texts that ``where`` (on doc_id) allows.

    A fifth of them (by hash) is set aside. These and all other labelled texts that ``where`` allows calibrate a threshold per language; a
    language with fewer than ``least`` such texts of either class takes the common one. The language is no input of the score.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words, bounds = word_rows(texts)
            cells = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rest = [part.column(part.schema.get_field_index(c)) for c in ("label", "lang", "doc_id")]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), *rest], ["f", "label", "lang", "doc_id"])

    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")
    texts = docs.select("doc_id", "text", lang)
    sample = labelled_sample(texts, labels, label, rows, where, ("lang",))
    aside = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0
    fit = sample.where(~aside).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", "lang")
    got = fit.mapInArrow(featurise, "f binary, label int, lang string, doc_id long").collect()
    got = sorted(got, key=lambda r: (bytes(r["f"]), r["label"], r["lang"] or ""))
    features = [np.frombuffer(r["f"], np.int32).reshape(-1, 1 + len(HEADS)) for r in got]
    model = fit_conv(features, np.array([r["label"] for r in got]))
    known = known_labels(labels, label, where)
    trained = docs.sparkSession.createDataFrame([(i,) for i in {r["doc_id"] for r in got}], "doc_id long")
    calibrate(model, texts, known, trained, least)
    return model


def score_toxicity(docs: DataFrame, model: ConvModel, column: str = "score", flag: str = "flagged") -> DataFrame:
    """All columns of ``docs``, ``column`` (0 to 1) and ``flag`` (score at or above the threshold of the row's language).

    Columns of these names are replaced. Every whole text is read in one pass without a shuffle. A NULL text counts as
    empty, a NULL or new language takes the common threshold.
    """
    docs = docs.drop(column, flag)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.withColumn(column, score_texts(lambda texts: shared.value.scores(*word_rows(texts))))
    cut = F.lit(float(model.threshold))
    if "lang" in docs.columns:
        for lang, own in sorted(model.thresholds.items()):
            cut = F.when(F.col("lang") == lang, F.lit(float(own))).otherwise(cut)
    return scored.withColumn(flag, F.col(column) >= cut)


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted and flagged of every document, learned from rows outside fold 0 of 5."""
    model = train_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0, rows=rows)
    lang = [c for c in ("lang",) if c in docs.columns]
    scored = score_toxicity(docs.select("doc_id", "text", *lang), model)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
