import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import fingerprints as fp
from panelmill.llm.common import ALNUM, BLANK_SEPARATED, Words
from panelmill.llm.graph import connected_components
from panelmill.llm.line_dedup import EDITS, allowed, join_lines, segment_keys, within
from panelmill.llm.ngram_join import shingle_sets, tree_join
from panelmill.operators.running import running_totals


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 5))
def test_banded_distance(a, b, k):
    assert within(a, b, k) == (distance(a, b) <= k)


def variants(rng, count, size):
    base = ["".join(rng.choice("abcdefgh ") for _ in range(size)) for _ in range(6)]
    out = set()
    while len(out) < count:
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("size", [21, 39, 41, 90])
def test_segments_find_every_pair_and_the_join_every_class(size):
    texts = variants(random.Random(size), 80, size)
    keys, owners, segment = segment_keys(texts)
    held = {}
    for key, own, kind in zip(keys.tolist(), owners.tolist(), segment.tolist()):
        held.setdefault(key, (set(), set()))[0 if kind else 1].add(own)
    met = {(a, b) for index, probes in held.values() for a in index for b in index | probes}
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            k = allowed(min(len(texts[a]), len(texts[b])), EDITS)
            if k >= 0 and distance(texts[a], texts[b]) <= k:
                assert (a, b) in met or (b, a) in met
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    found = list(range(len(texts)))
    for a, b in join_lines(list(range(len(texts))), texts, np.ones(len(texts), int), list(range(len(texts)))):
        low, high = sorted((found[a], found[b]))
        found = [low if x == high else x for x in found]
    assert found == label


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=24), min_size=2, max_size=14), st.sampled_from([50, 70, 80, 90]))
def test_tree_join_finds_exactly_the_pairs(sets, percent):
    found = set()
    tree_join([np.array(sorted(s), np.uint64) for s in sets], lambda i, js: found.update((min(i, j), max(i, j)) for j in js), percent)
    assert found == {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def test_word_hashes_depend_on_content_alone():
    texts = ["The cat\x00s, sat", "", "on THE mat\tthe\x0bend", None or "é É the"]
    words = Words(texts, BLANK_SEPARATED)
    assert np.diff(words.bounds).tolist() == [3, 0, 5, 3]
    h = words.hashes.tolist()
    assert h[0] == h[4] == h[6] == h[10] and len(set(h)) == 8
    assert np.diff(Words(["a-b c!", "!!"], ALNUM).bounds).tolist() == [3, 0]
    assert len(Words([], ALNUM).hashes) == 0


def test_shingles_of_short_texts():
    a, b, c, d, e = shingle_sets(["a b c d", "A B", "a b", " ", "b a"], 3)
    assert len(a) == 2 and b.tolist() == c.tolist() and len(b) == 1 and len(d) == 0 and b.tolist() != e.tolist()


@settings(max_examples=100, deadline=None)
@given(st.text("ab\U0001f600", max_size=40), st.text("ab\U0001f600", max_size=40), st.integers(0, 39), st.integers(0, 39))
def test_prefix_hashes(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert fp.common_extension(x, i, y, j) == k
    assert fp.span_equal(x, i, y, j, k) and not fp.span_equal(x, i, y, j, k + 1)


def test_likeness_of_fingerprints():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    b = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    f = fp.fingerprint
    assert fp.likeness(f(a), f(a)) == 1 and fp.likeness(f(a), f(b)) < 0.05 and fp.likeness(f(""), f(a)) == 0 and fp.likeness(f(""), f("")) == 1
    assert 0.35 < fp.likeness(f(a), f(fp.edited(a, b))) < 0.7
    assert fp.likeness(f(a), f(b[:2000] + a)) > 0.5  # moved, not only prefix or suffix
    assert len(f(a)) < 1000 and f("ab") != f("ba") != f("a")


def test_components_against_union_find(shared):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges[:-1]:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in connected_components(shared.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if Counter(label.values())[c] > 1}
    assert connected_components(shared.createDataFrame([], "a long, b long")).count() == 0


def test_running_totals_with_a_hot_and_a_null_group(shared):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "b", i, i % 5) for i in range(300)]
    got = running_totals(shared.createDataFrame(rows, "g string, o int, v long"), ["g"], ["o"], "v", "t").collect()
    for r in got:
        assert r["t"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"])
    assert len(got) == 300
