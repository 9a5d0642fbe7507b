import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelmill.llm import bpe, packing
from panelmill.llm.blocks import link_blocks
from panelmill.llm.embedding_dedup import link_vectors
from panelmill.llm.fingerprints import edited, fingerprint, fingerprint_documents
from panelmill.llm.line_dedup import dedup_lines, drop_repeated_lines
from panelmill.llm.ngram_join import link_documents
from panelmill.llm.queries import QUERIES
from panelmill.llm.sharding import longest_first, shard_by_size, shard_documents
from panelmill.llm.token_counts import count_tokens, document_token_counts, list_token_files

from .conftest import ODD
from .test_hashing import variants

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("operator", [shard_documents, fingerprint_documents, link_documents, dedup_lines, lambda d: bpe.token_digests(d, RANKS, PATTERN), lambda d: packing.pack_documents(d, WORDS),
                                      lambda d: document_token_counts(d, RANKS, PATTERN, 50256)])
def test_empty_tables(docs, operator):
    assert operator(docs([])).count() == 0


def test_sharding(docs):
    got = shard_documents(docs(ODD)).collect()
    assert sorted(key((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(key((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in ODD)
    text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in ODD}
    shard_of = {}
    for r in got:
        assert shard_of.setdefault(text[r["doc_id"], r["text_crc32"]], r["shard"]) == r["shard"]
    for s in {r["shard"] for r in got}:
        slots = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots)))


def test_sharding_is_even_and_numbers_large_groups_in_units(shared):
    rng = random.Random(1)
    data = [(i, f"g{i}", rng.randint(1, 400)) for i in range(4000)] + [(10_000 + i, "hot", 3) for i in range(2000)] + [(20_000, None, None), (20_001, None, 5)]
    got = shard_by_size(shared.createDataFrame(data, "id long, g string, v long"), "g", "v", ["id"], 6, unit_rows=150).collect()
    loads = [sum(r["v"] or 0 for r in got if r["shard"] == s) for s in range(6)]
    assert max(loads) - min(loads) <= 0.002 * sum(loads)
    assert len({r["shard"] for r in got if r["g"] == "hot"}) == len({r["shard"] for r in got if r["g"] is None}) == 1
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def one_by_one(sizes, shards):
    """Counts per (size, shard) of the schedule that takes every group alone, largest first, to the least loaded shard."""
    loads, counts = [0] * shards, {}
    for size in sorted(sizes, reverse=True):
        shard = loads.index(min(loads))
        loads[shard] += size
        counts[size, shard] = counts.get((size, shard), 0) + 1
    return counts, loads


@pytest.mark.parametrize("seed", range(20))
def test_classes_are_scheduled_like_single_groups(seed):
    """Ties, one huge group, many small ones: the bulk deal equals the heap."""
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 7, 50]) for _ in range(rng.choice([0, 5, 400]))] + [rng.randint(1, 300) for _ in range(rng.choice([0, 30]))] + [3000] * rng.choice([0, 1])
    shards = rng.choice([1, 3, 24])
    want, loads = one_by_one(sizes, shards)
    got = longest_first(sorted({s: sizes.count(s) for s in sizes}.items()), shards)
    assert {(s, k): n for s, counts in got.items() for k, n in enumerate(counts) if n} == want
    assert [sum(s * counts[k] for s, counts in got.items()) for k in range(shards)] == loads


def test_documents_are_sharded_by_the_schedule(docs):
    rng = random.Random(8)
    data = [(i, "x" * rng.choice([0, 1, 5, 5, 9, 200]) + rng.choice("abc")) for i in range(500)] + [(900, None), (901, ""), (902, "y" * 9000)]
    got = shard_documents(docs(data), 5).collect()
    groups = {}
    for _, t in data:
        groups[t or ""] = groups.get(t or "", 0) + len(t or "") + 8
    _, loads = one_by_one(groups.values(), 5)
    assert [sum(r["size"] for r in got if r["shard"] == s) for s in range(5)] == loads


def test_fingerprints(docs):
    got = fingerprint_documents(docs(ODD)).collect()
    order = sorted(((i, t or "") for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for at, (i, t) in enumerate(order):
        other = edited(t, order[(at + 1) % len(order)][1])
        want.append((i, len(t), hashlib.sha256(other.encode()).hexdigest(), fingerprint(t), fingerprint(other)))
    assert sorted(key(tuple(r)[:5]) for r in got) == sorted(map(key, want))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_fingerprints_of_one_document(docs):
    r = fingerprint_documents(docs([(3, "abcdef")])).first()
    assert (r["edited_sha256"], r["near_next"]) == (hashlib.sha256(b"abcdab").hexdigest(), 1.0)


def test_bpe_round_trip(docs):
    coder = bpe.encoding(RANKS, PATTERN)
    data = [*ODD, (11, " \n a \n\n  b　 c  "), (12, "é" * 3000), (13, "x" * 3000 + " " * 50)]
    got = rows(bpe.token_digests(docs(data), RANKS, PATTERN))
    want = []
    for i, t in data:
        ids = np.array(coder.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_decoding_a_table_of_ids(docs):
    got = rows(bpe.decode_ids(bpe.encode_documents(docs(ODD), RANKS, PATTERN), RANKS).select("doc_id", "decoded"))
    assert sorted(map(key, got)) == sorted(key((i, (t or "").encode())) for i, t in ODD)


@pytest.mark.parametrize("seed", range(3))
def test_words_are_encoded_independently(seed):
    rng = random.Random(seed)
    coder = bpe.encoding(RANKS, PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B7", " ", "  ", "\n", "\t", "'s", "é", "!", ".", " ", "\x1c", " ", "٣", "²"]) for _ in range(rng.randint(0, 12)))
        parts = bpe.words_of(text)
        words = [p[0] if isinstance(p, tuple) else " " + p for p in parts]
        assert "".join(words) == text
        assert [x for w in words for x in coder.encode_ordinary(w)] == coder.encode_ordinary(text)


def test_token_counts_over_blocks(docs, shared, tmp_path):
    coder = bpe.encoding(RANKS, PATTERN)
    got = document_token_counts(docs(ODD), RANKS, PATTERN, 50256).collect()
    assert sorted(key((r["doc_id"], r["n_tokens"])) for r in got) == sorted(key((i, len(coder.encode_ordinary(t or "")))) for i, t in ODD)
    streams = {"a.bin": [9, 1, 1, 9, 9, 2, 3, 4, 5, 6, 7, 8, 9, 1], "b.bin": [9], "c.bin": [], "d.bin": [1, 2, 3, 4, 5]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    found = count_tokens(list_token_files(shared, str(tmp_path)), 9, block_tokens=3).collect()
    got = sorted((r["file"][-5:], r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in found)
    assert got == [
        ("a.bin", 0, 0, 0, True), ("a.bin", 1, 1, 2, True), ("a.bin", 2, 4, 0, True), ("a.bin", 3, 5, 7, True), ("a.bin", 4, 13, 1, False),
        ("b.bin", 0, 0, 0, True), ("d.bin", 0, 0, 5, False),
    ]
    (tmp_path / "e.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple of 2"):
        count_tokens(list_token_files(shared, str(tmp_path)), 9).collect()


def test_packing(docs):
    data = [*ODD, *[(100 + i, f"word{i} " * (i % 90 + 1)) for i in range(60)]]
    sources = {i: "hot" if i % 3 else f"s{i % 5}" for i, _ in data if i} | {5: None}
    got = packing.pack_documents(docs(data, sources), WORDS, sequence=64, window=4).collect()
    coder = Tokenizer.from_file(WORDS)
    ids = {}
    for i, t in data:
        ids.setdefault(i, []).append(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces = []
    for r in got:
        own = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in own)
        pieces.append((r["sequence_id"], r["offset"], r["length"]))
    assert sum(p[2] for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    at = 0
    for number, offset, length in sorted(pieces):
        assert divmod(at, 64) == (number, offset) and offset + length <= 64
        at += length


def test_rounds_keep_the_mixture(shared):
    rng = random.Random(4)
    data = [(i, i, rng.choice(["a", "a", "b", None]), rng.randint(1, 40)) for i in range(3000)]
    df = shared.createDataFrame(data, "uid long, doc_id long, source string, n long")
    got = sorted(packing.deficit_round_robin(df, 2000).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == np.concatenate([[0], np.cumsum([r["n"] for r in got])[:-1]]).tolist()
    total = sum(d[3] for d in data)
    for source in ("a", "b", None):
        share = sum(d[3] for d in data if d[2] == source) / total
        sent = 0
        for k in range(max(r["round"] for r in got)):
            sent += sum(r["n"] for r in got if r["round"] == k and r["source"] == source)
            assert abs(sent - share * 2000 * (k + 1)) <= 40
    first = [r for r in packing.deficit_round_robin(df, 1000, {"a": 1, "b": 3}).collect() if r["round"] < 5]
    assert 0.7 < sum(r["n"] for r in first if r["source"] == "b") / sum(r["n"] for r in first) < 0.8


def test_word_cache_equals_the_tokenizer():
    rng = random.Random(2)
    coder, cache = Tokenizer.from_file(WORDS), packing.WordCache(WORDS, limit=50)
    assert coder.encode("<|endoftext|> end", add_special_tokens=False).ids == [49407, 806]
    assert np.frombuffer(cache.encode(["<|endoftext|> end"])[0], cache.kind).tolist() == [49407, 806]
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Bé", " ", "\n", " ", "\x1c", "é", "İ", "Σ", "ς", "12", "'S", "<|endoftext|>", "<|ENDofText|>", "a<|startoftext|>b", "ß", "　", "ﬁ", "\xad", "ª", "½", "Ł", "x", "ing", "the", "\x00", "é", "ŉ"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(cache.encode([text])[0], cache.kind).tolist() == coder.encode(text, add_special_tokens=False).ids


def test_packing_refuses_other_tokenizers():
    with pytest.raises(ValueError, match="packing expects"):
        packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def round_robin(rows, window):
    """Sources served in rounds, document by document: each round adds a source's quantum to its credit, and a source sends while it has some left."""
    queues = {}
    for uid, doc_id, source, n in sorted(rows, key=lambda r: (r[1], r[0])):
        queues.setdefault(source, []).append((uid, n))
    total = sum(r[3] for r in rows)
    quantum = {s: sum(n for _, n in q) / total * window for s, q in queues.items()}
    order, number = sorted(queues, key=lambda s: (s is not None, s or "")), 0
    credit, at, place = dict.fromkeys(queues, 0.0), 0, {}
    while any(queues.values()):
        for s in order:
            credit[s] += quantum[s]
            while queues[s] and credit[s] > 1e-9 * window:
                uid, n = queues[s].pop(0)
                place[uid] = (number, at)
                at, credit[s] = at + n, credit[s] - n
        number += 1
    return place


@pytest.mark.parametrize("seed", range(3))
def test_deficits_equal_a_simulation(shared, seed):
    rng = random.Random(seed)
    data = [(i, i, rng.choice(["a", "a", "b", None, "c"]), rng.choice([1, 7, 30, 400])) for i in range(400)]
    df = shared.createDataFrame(data, "uid long, doc_id long, source string, n long")
    got = {r["uid"]: (r["round"], r["at"]) for r in packing.deficit_round_robin(df, 137).collect()}
    assert got == round_robin(data, 137)


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("part_rows", [2000, 7])
def test_ngram_join_against_all_pairs(docs, monkeypatch, part_rows):
    from panelmill.llm import ngram_join

    whole = ngram_join.link_blocks
    monkeypatch.setattr(ngram_join, "link_blocks", lambda m, local: whole(m, local, part_rows=part_rows))
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(25, 120))] for _ in range(8)]
    data = list(ODD)
    for i in range(20, 110):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [f"n{rng.randrange(9)}"] * 2])
        data.append((i, rng.choice([" ", "\n"]).join(words)))
    sets = [shingles(t) for _, t in data]
    label = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    want = []
    for (i, _), s, c in zip(data, sets, label):
        ids = [j for (j, _), d in zip(data, label) if d == c and j is not None]
        want.append((i, len(s), min(ids) if i is not None else None))
    assert sorted(map(key, rows(link_documents(docs(data))))) == sorted(map(key, want))


def test_chained_blocks_meet_by_their_keys(docs, monkeypatch):
    """A block that weak keys have chained sends each text to the few that share one of its n-grams, not to all parts; classes are those of all pairs, and few steps stay stored."""
    from panelmill.llm import blocks, ngram_join

    whole, met = ngram_join.link_blocks, []
    joined = blocks._joined
    monkeypatch.setattr(ngram_join, "CHAINED", 10, raising=False)
    monkeypatch.setattr(ngram_join, "link_blocks", lambda m, local: whole(m, local, part_rows=5))
    monkeypatch.setattr(blocks, "_joined", lambda rows, keys, local: met.append(rows.count()) or joined(rows, keys, local))
    data = []
    for i in range(60):
        words = [f"s{j}v{k}" for j in (i - 1, i) for k in range(16)]
        words[16:16] = [f"x{i}y{k}" for k in range(60)]
        data.append((i, " ".join(words)))
        data.append((100 + i, data[-1][1].replace(f"x{i}y20 ", "other ")) if i % 15 == 0 else (200 + i, None))
    sets = [shingles(t) for _, t in data]
    label = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    want = [(i, len(s), min(j for (j, _), d in zip(data, label) if d == c)) for (i, _), s, c in zip(data, sets, label)]
    found = link_documents(docs(data), percent=60)
    assert sorted(rows(found)) == sorted(want)
    assert sum(met) < 400


@pytest.mark.parametrize("part_rows", [2000, 9])
def test_line_dedup_against_all_pairs(docs, monkeypatch, part_rows):
    from panelmill.llm import line_dedup

    from .test_hashing import distance

    whole = line_dedup.link_blocks
    monkeypatch.setattr(line_dedup, "link_blocks", lambda m, local: whole(m, local, part_rows=part_rows))
    rng = random.Random(6)
    lines = variants(rng, 45, 50) + variants(rng, 30, 25) + ["short", "", "a repeated line of some length"]
    data = [*ODD, *[(100 + i, "\n".join(rng.choice(lines) for _ in range(4))) for i in range(30)], (11, "the same row\nof two lines, one of them long"), (11, "the same row\nof two lines, one of them long")]
    spots = sorted({(i is not None, i or 0, line_dedup.document_keys([t or ""])[0], j, x) for i, t in data for j, x in enumerate((t or "").split("\n")) if len(x) >= 20})
    known: list = []
    classes: list = []
    for *_, x in spots:
        if x not in known:
            known.append(x)
            near = [c for c in classes if any(line_dedup.allowed(min(len(x), len(y))) >= distance(x, y) if abs(len(x) - len(y)) < 3 and len(x) < 200 and len(y) < 200 else x == y for y in c)]
            classes = [c for c in classes if c not in near] + [{x}.union(*near)]
    first = {}
    for s in spots:
        c = next(i for i, c in enumerate(classes) if s[4] in c)
        first.setdefault(c, s[:4])
    drop = {}
    for s in spots:
        if first[next(i for i, c in enumerate(classes) if s[4] in c)] != s[:4]:
            drop.setdefault(s[:3], set()).add(s[3])
    want = []
    for i, t in data:
        own = drop.get((i is not None, i or 0, line_dedup.document_keys([t or ""])[0]), set())
        parts = (t or "").split("\n")
        want.append((i, len(parts), len(own), tuple(sorted(own)), None if t is None else "\n".join(x for j, x in enumerate(parts) if j not in own)))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], tuple(r["dropped_lines"]), r["text"]) for r in dedup_lines(docs(data)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    kept = drop_repeated_lines(docs(data))
    assert kept.columns == [*docs(data).columns, "dropped_lines"] and kept.count() == len(data)


@pytest.mark.parametrize("part_rows", [4096, 8])
def test_vectors_against_all_pairs(shared, part_rows):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 24))
    data = [(int(i), (x[i % 12] + 0.05 * rng.normal(size=24) if i % 3 else x[i]).tolist()) for i in range(60)]
    data += [(100 + i, x[1].tolist()) for i in range(5)] + [(105, (x[1] * 1e200).tolist())]
    odd = [(200, None), (201, [0.0] * 24), (202, [float("nan")] * 24), (203, [None, 1.0]), (204, []), (205, [float("inf")] + [1.0] * 23), (206, [1.0, 0.0]), (207, [1.0, 1e-9]), (207, [1.0, 1e-9])]
    df = shared.createDataFrame([(i, v, 1, 0, "r") for i, v in data + odd], "vec_id long, embedding array<double>, label int, copies int, rep string")
    got = {}
    for r in link_vectors(df, part_rows=part_rows).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    v = np.array([d / np.abs(d).max() for d in np.array([d for _, d in data])])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    label = np.array([i for i, _ in data])
    for _ in range(70):
        label = np.array([label[near[i]].min() for i in range(len(data))])
    for k, (i, _) in enumerate(data):
        assert got[i] == [(int(near[k].sum()) - 1, int(label[k]), bool(label[k] == i))]
    for i in range(200, 206):
        assert got[i] == [(0, i, True)]
    assert got[206] == [(2, 206, True)] and got[207] == [(2, 206, False)] * 2
    assert link_vectors(df.limit(0)).count() == 0


def test_short_lines_repeat_at_distance_0(docs, tmp_path):
    data = [(1, "Les.\n\nLes.\nLer."), (2, "Les.\nnineteen characters\na line of twenty ch."), (3, "a line of twenty ch!\nnineteen characterz\n\nL")]
    docs(data).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["dropped_lines"] for r in QUERIES["op1_line_dedup"](docs(data).sparkSession, str(tmp_path)).collect()}
    assert got == {1: [2], 2: [0], 3: [0]}


def test_parts_outside_the_largest_class_are_bounded_by_characters(shared):
    def local(nodes, texts, side, components):
        if sum(map(len, texts)) > 20_000:
            raise ValueError("too many characters in a task")
        return []

    members = shared.createDataFrame([(i, 0, "x" * 1000) for i in range(40)], "node long, block long, text string")
    assert link_blocks(members, local, part_chars=5000).count() == 0
