import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelmill.llm.alignment import align_documents, bitmaps, index_links, pair_counts, tokenizers, words_of

from .conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(data):
    """Whole texts through both libraries, all token pairs compared by their byte ranges."""
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    spell = tokenizers(A, B)[0]
    aligned = []
    for doc_id, text in data:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        spell_a = [spell.bytes_of(np.array([i])).tobytes() for i in a]
        spell_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [right.id_to_piece(i)]]
        if not text or b"".join(spell_a) != b" " + text.encode() or b"".join(spell_b) != b" " + text.encode():
            aligned.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spell_a, spell_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for side, (ids, end) in enumerate(zip((a, b), ends, strict=True)):
            for i, e in zip(ids, end, strict=True):
                groups[bisect_left(both, e)][side].append(i)
        links, low, starts = [], 0, [0, *ends[1]]
        for i, (e, s) in enumerate(zip(ends[0], [0, *ends[0]], strict=False)):
            while ends[1][low] <= s:
                low += 1
            j = low
            while j < len(b) and starts[j] < e:
                links.append((a[i], b[j]))
                j += 1
        aligned.append((doc_id, a, b, groups, links))
    count = Counter(x for *_, links in aligned for x in links)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, a, b, groups, links in aligned:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, count


def key(row):
    return tuple((x is not None, x) for x in row)


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "The", "quick", "naïve", "Straße", "日本語", "\U0001f600", "don't", "1234567", "§", "...", "\x00", "\x1c", "　", "\n", "\t", "  ", "   ", "<s>", "<0x41>", "<|endoftext|>", "x" * 50, "ﬁ", "é"]
    texts = [rng.choice(["", " "]) + rng.choice([" ", " ", ""]).join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return ODD + [(100 + k, t) for k, t in enumerate(texts)] + [(500, "▁ is spelled as a blank"), (501, "same words " * 50), (502, "same words"), (503, " "), (504, "  end  ")]


def test_equals_brute_force(docs):
    data = odd_texts()
    want, count = brute(data)
    frame = docs(data).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in align_documents(frame, A, B).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    pairs = {(r["a"], r["b"]): (r["n_links"], r["n_docs"]) for r in pair_counts(index_links(frame, A, B)).collect()}
    assert {k: n for k, (n, _) in pairs.items()} == dict(count)
    assert all(1 <= d <= n for n, d in pairs.values())


def test_words_are_encoded_independently():
    left, right = tokenizers(A, B)
    for _, text in odd_texts():
        if not text:
            continue
        words = words_of(text)
        assert " ".join(words) == text
        assert [i for x in left.encode(words) for i in x] == left.loaded.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in right.encode(words) for i in x] == right.loaded.encode(text)


def test_empty_table(docs):
    assert align_documents(docs([]), A, B).count() == 0
    assert [tuple(r) for r in align_documents(docs([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("rows", [10, 300, 5000])
def test_bitmaps(rows):
    rng = np.random.default_rng(rows)
    key = np.unique(rng.integers(0, 6, 2000) ** 2 << 16 | rng.integers(0, rows, 2000) * rng.integers(0, 2, 2000))
    got = []
    for pair, n, dense, data in bitmaps(key >> 16, key & 0xFFFF, rows):
        for p, m, x in zip(pair.tolist(), n.tolist(), data.to_pylist(), strict=True):
            places = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) if dense else np.frombuffer(x, "<u2")
            assert len(places) == m
            got += [p << 16 | i for i in places.tolist()]
    assert sorted(got) == key.tolist()
