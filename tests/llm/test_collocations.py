import random
import re
from collections import Counter

import numpy as np

from panelmill.llm.collocations import collocations, multikey_counts

from .conftest import ODD


def brute(rows, least=10, share=50, top=2000):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    rows, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            rows.append((lang, seen[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return rows


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_equals_brute_force(shared):
    """Odd texts, a NULL language, common words and pairs (of any share here), rare words between them, and clashing columns."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["New", "YORK", "é", "a\x00b", "x'y"]
    rows = [("en", t) for _, t in ODD]
    for _ in range(400):
        text = [rng.choice(words) if rng.random() > 0.1 else f"rare{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            text += ["new", "york", rng.choice(["times", "city", f"u{rng.randint(0, 10**6)}"])] * rng.randint(1, 3)
        rows.append((rng.choice(["en", "de", None, ""]), "".join(w + rng.choice([" ", "  ", "\t", ". ", "\r\n", ", "] if rng.random() < 0.2 else [" "]) for w in text)))
    data = [(i, t, lang, 1, "w", 2) for i, (lang, t) in enumerate(rows)]
    frame = shared.createDataFrame(data, "doc_id long, text string, lang string, n long, phrase string, words int")
    for top in (2000, 7):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(frame.repartition(5), top=top).collect())
        assert got == sorted(brute(rows, top=top))
    assert len(got) == 28


def test_words_rare_by_themselves_and_many_copies(shared):
    rows = [("en", "alpha beta gamma delta")] * 9 + [("en", "alpha beta. gamma"), ("de", "alpha beta gamma")]
    frame = shared.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert [tuple(r[c] for c in COLUMNS) for r in collocations(frame).collect()] == brute(rows) == [("en", 1, "alpha beta", 10, 10, 10, 39, 1_000_000)]


def test_empty_table(docs):
    assert collocations(docs([])).count() == 0
    assert collocations(docs([(1, None), (2, " \n.")])).count() == 0


def test_products_beyond_64_bits(shared):
    """The score's arithmetic alone, with counts whose products need 110 bits."""
    from panelmill.llm import collocations as module

    a, left, right = 3_000_000_000_000_007, 4_000_000_000_000_037, 3_999_999_999_999_989
    totals = shared.createDataFrame([("en", 10)], "lang string, n long")
    phrases = shared.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, words int, a long")
    own = module.phrase_counts
    module.phrase_counts = lambda *_: (totals, phrases)
    try:
        assert collocations(shared.range(1)).first()["score"] == 1_000_000 * a * a // (left * right)
    finally:
        module.phrase_counts = own


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    keys = [rng.integers(0, 30, 5000), rng.integers(0, 12, 5000), rng.integers(-1, 5, 5000)]
    weights = rng.integers(1, 4, 5000)
    for least in (1, 9, 60):
        got = {tuple(int(k[p]) for k in keys[:d]): int(n) for d, pointers, counts in multikey_counts(keys, weights, least) for p, n in zip(pointers, counts, strict=True)}
        want = Counter()
        for i in range(5000):
            for d in (1, 2, 3):
                if keys[d - 1][i] >= 0:
                    want[tuple(int(k[i]) for k in keys[:d])] += int(weights[i])
        assert got == {k: v for k, v in want.items() if v >= least}
