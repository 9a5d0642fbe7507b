import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelmill.llm.common import fold
from panelmill.llm.quality import fit_nbsvm, quality_scores, score_quality, train_quality
from panelmill.llm.toxicity import best_threshold, cut_of_bins, score_toxicity, toxicity_scores, train_toxicity, word_rows

from .conftest import ODD


@pytest.fixture
def corpus(docs, shared):
    rng = random.Random(1)
    data, labels = list(ODD), []
    for i in range(1000, 1500):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(60)]
        quality, toxic = int(rng.random() < 0.7), int(rng.random() < 0.3)
        if not quality:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vileword", "vilewordish"])
        data.append((i, " ".join(words)))
        labels.append((i, quality, toxic))
    labels += [(1000, None, None), (None, 1, 1), (5, 1, 0), (10**9, 0, 1)]
    return docs(data), shared.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label"), [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_scores_on_held_out_rows(corpus, operator, label):
    texts, labels = corpus
    got = operator(texts, labels).collect()
    assert len(got) == texts.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r["doc_id"] and r[label] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] and r["doc_id"] >= 1000]
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1


def test_labels_of_held_out_rows_are_not_learned(corpus):
    texts, labels = corpus
    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality_scores(texts, x).where("doc_id is not null").collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(5, 1, 1)]])
def test_no_or_one_label(docs, shared, rows):
    labels = shared.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for operator in (quality_scores, toxicity_scores):
        assert operator(docs(ODD), labels).count() == len(ODD)
        assert operator(docs([]), labels).count() == 0


def test_all_columns_are_kept_and_thresholds_follow_the_language(corpus):
    texts, labels = corpus
    model = train_toxicity(texts, labels, F.lit(True))
    assert set(model.thresholds) == {"en"}
    model.thresholds = {"en": 0.0}
    got = score_toxicity(texts.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")), model)
    assert got.columns == [*[c for c in texts.columns if c != "score"], "score", "flagged"]
    assert got.where("lang = 'en' and not flagged").count() == 0
    assert got.where("lang is null and flagged <> (score >= {})".format(model.threshold)).count() == 0
    assert score_quality(texts, train_quality(texts, labels, F.lit(True))).columns == [*[c for c in texts.columns if c != "score"], "score"]


def test_thresholds_and_padding():
    assert best_threshold(np.array([0.9, 0.7, 0.2]), np.array([1, 1, 0])) == pytest.approx(0.45)
    assert best_threshold(np.array([0.9]), np.array([1])) == 0.5
    words, bounds = word_rows(["a b", "", "c"])
    assert bounds.tolist() == [0, 5, 8, 12] and words.shape == (12, 3)


def test_pipeline(corpus, shared, tmp_path):
    texts, labels = corpus
    plain = texts.select("doc_id", "text", "lang", "source", "n_chars")
    passage = "a passage of many words that is found in several documents of the corpus"
    more = [(2000, f"{passage}\nbub dam fer gol cus", "en", "s", 9), (2001, f"bab dum far gil ces\n{passage}", "en", "s", 9), (2002, passage, "en", "s", 9)]
    plain = plain.unionByName(shared.createDataFrame(more, plain.schema))
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = shared.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(shared, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = seen[name] = shared.read.parquet(str(tmp_path / f"stage{i}"))
        if name != "packing":
            assert docs.columns == plain.columns
    truth = {r["doc_id"]: r for r in labels.where("doc_id >= 1000 and quality is not null").collect()}
    kept = {r["doc_id"] for r in seen["toxicity"].select("doc_id").collect() if r["doc_id"] and 1000 <= r["doc_id"] < 1500}
    clean = {i for i, r in truth.items() if r["quality"] and not r["toxic"] and i < 1500}
    assert len(kept & clean) > 0.97 * len(clean) and len(kept - clean) < 0.03 * len(truth)
    after = {r["doc_id"]: r for r in seen["line_dedup"].where("doc_id >= 2000").collect()}
    before = {r["doc_id"] for r in seen["toxicity"].where("doc_id >= 2000").select("doc_id").collect()}
    first = min(before)
    assert set(after) == before - ({2002} if first < 2002 else set())
    assert all((passage in r["text"]) == (i == first) for i, r in after.items())
    assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if i != first)
    packed = {r["doc_id"] for r in seen["packing"].select("doc_id").collect()}
    assert packed == {r["doc_id"] for r in seen["ngram_join"].select("doc_id").collect()}
    assert sorted(map(str, corpus_pipeline.run(shared, str(tmp_path)).collect())) == sorted(map(str, seen["packing"].collect()))


def test_near_copies_of_five_word_similarity_go(docs, shared, tmp_path):
    words = [f"w{i}" for i in range(150)]
    near = [f"x{i}" if i in (40, 80, 120) else w for i, w in enumerate(words)]
    far = [f"y{i}" if i % 25 == 9 else w for i, w in enumerate(words)]
    five, three = ([{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (words, near, far)] for n in (5, 3))
    like = [len(a & b) / len(a | b) for a, b in ((five[0], five[1]), (three[0], three[1]), (five[0], five[2]))]
    assert like[0] == pytest.approx(0.81, abs=0.02) and like[1] < 0.9 and like[2] < 0.8
    table = docs([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_first_copies(shared, table, str(tmp_path)).collect()) == [1, 3]


def test_rows_of_one_id_and_rows_without_one_are_not_lost(docs, shared, tmp_path):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdegh"}
    rows = [(5, text["a"]), (5, text["b"]), (None, text["c"]), (None, text["d"]), (6, text["e"]), (3, text["g"]), (9, text["g"]), (9, text["h"]), (6, text["e"]), (7, ""), (7, ""), (8, None), (None, text["c"])]
    got = corpus_pipeline.keep_first_copies(shared, docs(rows), str(tmp_path))
    assert got.columns == docs(rows).columns
    want = [(5, text["a"]), (5, text["b"]), (None, text["c"]), (None, text["d"]), (6, text["e"]), (3, text["g"]), (9, text["h"]), (7, ""), (7, ""), (8, None), (None, text["c"])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.keep_first_copies(shared, docs([]), str(tmp_path)).count() == 0


def test_stages_on_an_empty_table(docs, shared, tmp_path):
    shared.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(shared, docs([]), str(tmp_path)).count() == 0


def test_hinge_loss_is_minimal():
    """The fitted weights against the optimality conditions of the hinge loss, which no other point meets: margins decide the multipliers."""
    rng = np.random.default_rng(1)
    features = [np.unique(rng.integers(0, 40, rng.integers(3, 12))).astype(np.int32) + (20 if k % 3 == 0 else 0) for k in range(90)]
    labels = np.array([int(k % 3 == 0) for k in range(90)])
    model = fit_nbsvm(features, labels, epochs=3000)
    y = np.where(labels > 0, 1.0, -1.0)
    count = {s: np.ones(2**18) for s in (1.0, -1.0)}
    for f, s in zip(features, y, strict=True):
        count[s][f] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    x = np.zeros((90, 60))
    for k, f in enumerate(features):
        x[k, f] = ratio[f] / np.sqrt(len(f))
    cost = np.where(y > 0, 90 / (2 * (y > 0).sum()), 90 / (2 * (y < 0).sum()))

    def primal(w, bias):
        return 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - y * (x @ w + bias))).sum()

    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(ratio[:60] != 0, model.weights[:60] / ratio[:60], 0.0)
    best = primal(own, model.bias)
    alpha, w, bias = np.zeros(90), np.zeros(60), 0.0
    for _ in range(4000):
        for k in range(90):
            new = min(max(0.0, alpha[k] - (y[k] * (x[k] @ w + bias) - 1) / (x[k] @ x[k] + 1)), cost[k])
            w, bias, alpha[k] = w + (new - alpha[k]) * y[k] * x[k], bias + (new - alpha[k]) * y[k], new
    dual = alpha.sum() - 0.5 * (w @ w + bias * bias)
    assert dual - 1e-6 <= best <= dual * (1 + 1e-3)
    for _ in range(200):
        assert primal(own + rng.normal(0, 0.05, 60), model.bias + rng.normal(0, 0.05)) >= best * (1 - 1e-4)


def test_scores_equal_a_loop(corpus):
    """Toxicity scores against windows taken one by one; texts end in padding."""
    texts, labels = corpus
    model = train_toxicity(texts, labels, F.lit(True), rows=200)
    plain = ["bub dam", "", "a long text " * 9]
    rows, bounds = word_rows(plain)
    for k, got in enumerate(model.scores(rows, bounds)):
        own = rows[bounds[k] : bounds[k + 1]]
        e = model.embedding[own].sum(1).astype(float)
        pooled = []
        for width, w in zip((1, 2, 3), model.filters, strict=True):
            pooled.append(np.max([np.tensordot(e[i : i + width], w.astype(float), 2) for i in range(len(e) - 2)], axis=0))
        margin = np.tanh(np.concatenate(pooled)) @ model.output + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-5)


def test_copies_with_short_and_blank_lines_go(docs, shared, tmp_path):
    long = ["the first long line of a text that is found twice", "another long line of the text that is found twice"]
    texts = [
        (1, f"Title\n{long[0]}\n\n{long[1]}\nend."), (2, f"Title\n{long[0]}\n\n{long[1]}\nend."), (3, f"{long[0]}\n \n"), (4, f"Title\n{long[0]}\nown"),
        (5, "Title\nend."), (6, "Title\na long line that only this text has\nend."),
    ]
    lines = corpus_pipeline.drop_lines(shared, docs(texts), str(tmp_path))
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    want = {1: texts[0][1], 4: "Title\nown", 5: texts[4][1], 6: texts[5][1]}
    assert left == {i: (t, len(t)) for i, t in want.items()}
    assert {r["doc_id"] for r in corpus_pipeline.keep_first_copies(shared, lines, str(tmp_path)).collect()} == {1, 4, 5, 6}


def test_calibration_grows_with_the_labels(corpus):
    texts, labels = corpus
    texts = texts.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "fr").otherwise("en"))
    assert set(train_toxicity(texts, labels, F.lit(True), rows=100, least=30).thresholds) == {"en", "fr"}
    assert set(train_toxicity(texts, labels, fold(F.col("doc_id"), 5) == 0, rows=100, least=30).thresholds) == set()
    rng = np.random.default_rng(2)
    scores, y = rng.random(300).round(2), rng.integers(0, 2, 300)
    values = np.unique(scores)
    n, positive = (np.array([f(y[scores == v]) for v in values]) for f in (len, sum))
    assert cut_of_bins(values, values, n, positive) == best_threshold(scores, y)
