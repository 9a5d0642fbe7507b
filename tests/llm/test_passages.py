import hashlib
import random

import numpy as np
import pytest

from panelmill.llm import passages
from panelmill.llm.passages import common_prefixes, drop_repeats, repeat_digests

from .conftest import ODD


def brute(rows, least):
    """(doc_id, bytes, removed flags, kept) by a dictionary of all windows, in order of the documents."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
    seen, out = set(), []
    for k in order:
        doc_id, data, _ = rows[k]
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - least + 1):
            window = data[i : i + least]
            if window in seen:
                gone[i : i + least] = True
            seen.add(window)
        edges = np.diff(gone.astype(int), prepend=0)
        out.append((doc_id, len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def texts(seed):
    """Passages that many texts share, edited copies, periodic texts, a common short line, many-byte characters."""
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "é", "žluť", "日本", "x" * 30]
    passage = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(40)) for _ in range(4)]
    line = "this short line stands in very many texts, but not 100 bytes"
    out = []
    for _ in range(60):
        parts = [" ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(rng.randint(0, 60)))]
        if rng.random() < 0.5:
            p = rng.choice(passage)
            cut = rng.randint(0, 150)
            parts.append(p[cut : cut + rng.randint(60, 300)])
        if rng.random() < 0.4:
            parts.append(line)
        if rng.random() < 0.2:
            parts.append("ab" * rng.randint(30, 120))
        if rng.random() < 0.1:
            parts.append("z" * rng.choice([99, 100, 101, 400]))
        if out and rng.random() < 0.2:
            copied = list(rng.choice(out))
            if copied and rng.random() < 0.7:
                copied[rng.randrange(len(copied))] = "#"
            parts = ["".join(copied)]
        rng.shuffle(parts)
        out.append("\n".join(parts))
    return out


@pytest.mark.parametrize("hot", [2048, 2])
def test_equals_brute_force(docs, shared, monkeypatch, hot):
    """Also with almost all anchors taken as hot, and rows over many partitions."""
    monkeypatch.setattr(passages, "HOT", hot)
    rng = random.Random(hot)
    data = [(rng.randint(0, 80), t) for t in texts(hot)] + ODD + [(None, "no id " * 40), (None, "no id " * 41), (3, "no id " * 40)]
    frame = docs(data).repartition(4)
    hashes = {r["text"]: r["h"] for r in passages._keyed(frame).collect()}
    rows = [(i, (t or "").encode(), hashes[t or ""]) for i, t in data]
    for least in (100, 30):
        got = [tuple(r) for r in repeat_digests(frame, least).collect()]
        assert sorted(map(key, got)) == sorted(map(key, brute(rows, least)))


def test_spans_and_kept_bytes(docs):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    r = {x["doc_id"]: x for x in drop_repeats(docs([(1, text), (2, "?" + text[:120] + "!" + text[20:])]), 50).collect()}
    assert [tuple(s) for s in r[2]["spans"]] == [(1, 121), (122, 122 + len(text) - 20)] and bytes(r[2]["kept"]) == b"?!"
    assert r[1]["spans"] == [] and bytes(r[1]["kept"]).decode() == text


def test_empty_and_short(docs):
    assert repeat_digests(docs([])).count() == 0
    got = repeat_digests(docs([(1, None), (2, "a" * 99), (2, "a" * 99)])).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == [(1, 0, 0), (2, 99, 0), (2, 99, 0)]


@pytest.mark.parametrize("seed", range(40))
def test_common_prefixes(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(60))
    text, left = [], []
    for _ in range(rng.randint(1, 12)):
        at = rng.randint(0, 40)
        part = bytearray(base[at : at + rng.randint(0, 40)])
        if part and rng.random() < 0.3:
            part[rng.randrange(len(part))] = ord("z")
        text += [b + 1 for b in part] + [0]
        left += range(len(part), -1, -1)
    text, left, least = np.array(text, np.uint8), np.array(left), rng.choice([9, 10, 13, 20, 33])
    order, value = common_prefixes(text, left, least)
    suffix = lambda i: tuple(text[i : i + left[i]])
    assert sorted(order.tolist()) == list(range(len(text)))
    for q in range(1, len(text)):
        a, b = suffix(order[q - 1]), suffix(order[q])
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert value[q] == (n if n < least else 255)
