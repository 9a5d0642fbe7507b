"""Alignment of two tokenizers over a corpus: which ids share bytes, and how often."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from panelmill.llm.bpe import ragged
from panelmill.llm.common import slices
from panelmill.session import cut_lineage

#: A block of documents holds about so many characters, and at most so many rows (places in a bitmap are 16-bit numbers).
BLOCK_CHARS, BLOCK_ROWS = 16_000_000, 60_000
#: A task's word table is dropped after the block in which it passes so many words or bytes.
MOST_WORDS, MOST_BYTES = 400_000, 100_000_000
# Fixed value: the pattern that byte-level files split by when they ask for it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no version of Unicode changes; other words go through the tokenizer itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
_ODD_BLANKS = re.compile(r"\s\s|\A | \Z")
_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Ids and their bytes: one blob, with start and length of each id."""

    def __init__(self, table: list[bytes]):
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.data, self.starts[ids], self.lengths[ids])


class ByteLevel(Tokens):
    """A byte-level BPE file. Its strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.loaded = Tokenizer.from_file(path)
        self.loaded.encode_special_tokens = True
        kind = json.loads(self.loaded.to_str())
        if kind["normalizer"] or kind["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is not a plain byte-level file")
        # Such files write printable bytes as themselves and the others, in order, as the characters from 256 on.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        table = [b""] * self.loaded.get_vocab_size()
        added = {t["id"] for t in kind["added_tokens"]}
        for token, number in self.loaded.get_vocab().items():
            if number not in added:
                table[number] = bytes(byte_of[c] for c in token)
        ranks = {x: i for i, x in enumerate(table) if x}
        self.fast = tiktoken.Encoding("aligned", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        super().__init__(table)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of the words with a blank before each."""
        out = [self.fast.encode_ordinary(" " + w) if _PLAIN.fullmatch(w) else None for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, got in zip(rest, self.loaded.encode_batch_fast([" " + words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = got.ids
        return out


class Pieces(Tokens):
    """A SentencePiece file that puts a blank before the text and changes nothing else, and whose pieces hold blanks only at their start."""

    def __init__(self, path: str):
        self.loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.loaded.serialized_model_proto())
        spec = model.normalizer_spec
        inner = any("▁" in p.piece.lstrip("▁") for p in model.pieces)
        if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or inner:
            raise ValueError(f"{path} does not encode words apart")
        byte = model.SentencePiece.BYTE
        super().__init__([bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in model.pieces])

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of the words; the file puts the blank before each."""
        return self.loaded.encode(words, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


def words_of(text: str) -> list[str]:
    """Words that are encoded apart, each with one blank before it: cut at every single blank between two non-blanks.

    No match of the byte-level pattern spans such a place, and no piece holds a blank behind another character, so both tokenizers end a token there.
    """
    return _INNER_BLANK.split(text) if _ODD_BLANKS.search(text) else text.split(" ")


class WordTable:
    """What the words of a task have in both tokenizers: numbers of ids, groups and links, the linked pairs, the groups in writing."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b, self.many = a, b, len(b.lengths)
        self.number: dict[str, int] = {}
        self.written: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.bad = np.zeros(0, bool)
        self.pairs, self.starts, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # Each id in decimals with each of the three signs that may follow it.
        signed = [f"{i}{sign}".encode() for i in range(max(len(a.lengths), self.many)) for sign in ",|;"]
        self.decimals = Tokens(signed)

    def learn(self, words: list[str]) -> None:
        fresh = list(set(words).difference(self.number))
        if not fresh:
            return
        for word in fresh:
            self.number[word] = len(self.number)
        a, b = self.a.encode(fresh), self.b.encode(fresh)
        data = [b" " + w.encode("utf-8", "surrogatepass") for w in fresh]
        bad = ~(self._spells(self.a, a, data) & self._spells(self.b, b, data))
        for k in np.flatnonzero(bad).tolist():
            a[k] = b[k] = []
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        fa, fb = (np.fromiter((i for own in x for i in own), np.int64, n) for x, n in ((a, int(na.sum())), (b, int(nb.sum()))))
        end_a, end_b = np.cumsum(self.a.lengths[fa]), np.cumsum(self.b.lengths[fb])
        start_a, start_b = end_a - self.a.lengths[fa], end_b - self.b.lengths[fb]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        # Every A token overlaps the B tokens from the first that ends behind its start to the last that starts before its end.
        first = np.searchsorted(end_b, start_a, side="right")
        links = np.searchsorted(start_b, end_a, side="left") - first
        pairs = np.repeat(fa, links) * self.many + ragged(fb, first, links)
        upto = lambda n, x: np.concatenate([[0], np.cumsum(x)])[np.cumsum(n)] - np.concatenate([[0], np.cumsum(x)])[np.cumsum(n) - n]
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        n_links = upto(na, links)
        self.counts = np.concatenate([self.counts, np.stack([na, nb, upto(na, last_a), n_links], axis=1)])
        self.bad = np.concatenate([self.bad, bad])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.pairs = np.concatenate([self.pairs, pairs])
        # In writing a group's A ids come before its B ids.
        order = np.empty(len(fa) + len(fb), np.int64)
        order[np.arange(len(fa)) + np.searchsorted(group_b, group_a, side="left")] = fa * 3 + last_a
        order[np.arange(len(fb)) + np.searchsorted(group_a, group_b, side="right")] = fb * 3 + 2 * last_b
        text = self.decimals.bytes_of(order).tobytes()
        ends = np.cumsum(upto(na + nb, self.decimals.lengths[order])).tolist()
        self.written += [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        self.size += len(text) + sum(map(len, data))

    @staticmethod
    def _spells(tokens: Tokens, ids: list[list[int]], data: list[bytes]) -> np.ndarray:
        """Whether the bytes of each word's ids are the word's own."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for own in ids for i in own), np.int64, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(tokens.lengths[flat])])
        starts, size = ends[np.cumsum(n) - n], np.fromiter(map(len, data), np.int64, len(data))
        good = ends[np.cumsum(n)] - starts == size
        spelled, wanted = tokens.bytes_of(flat), np.frombuffer(b"".join(data), np.uint8)
        own = size[good]
        differ = ragged(spelled, starts[good], own) != ragged(wanted, (np.cumsum(size) - size)[good], own)
        bounds = np.cumsum(own) - own
        if len(own):
            good[np.flatnonzero(good)[np.logical_or.reduceat(differ, bounds)]] = False
        return good


STORED = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, plane int, n int, dense boolean, docs binary"
_NAMES = [c.split()[0] for c in STORED.split(", ")]
_KINDS = dict(zip(_NAMES, [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.binary()], strict=True))


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(k), pa.Array) else pa.array(c, kind) if c is not None else pa.nulls(size, kind) for k, kind in _KINDS.items()], _NAMES)


def bitmaps(pair: np.ndarray, place: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, pa.Array]]:
    """(pairs, popcounts, dense, bitmaps) of sorted (pair, place) entries: 16-bit places in order, or one bit a place where that is shorter."""
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(np.append(starts, len(pair)))
    dense = n * 16 > rows
    for kind in (False, True):
        own = dense == kind
        if not own.any():
            continue
        flat = ragged(place, starts[own], n[own])
        if kind:
            data = []
            for places in np.split(flat, np.cumsum(n[own])[:-1]):
                bits = np.zeros(rows, np.uint8)
                bits[places] = 1
                data.append(np.packbits(bits).tobytes())
            column = pa.array(data, pa.binary())
        else:
            ends = np.concatenate([[0], np.cumsum(n[own] * 2)]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), int(own.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())])
        yield pair[starts[own]], n[own], kind, column


def _planes(block: int, rows: int, many: int, keys: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a block: plane 0 has the documents that hold a pair linked, plane k those with bit k - 1 in the number of their further links."""
    key, more = np.concatenate(keys), np.concatenate(times) - 1
    order = np.argsort(key, kind="stable")
    key, more = key[order], more[order]
    plane, held = 0, np.ones(len(key), bool)
    while len(key):
        for pair, n, dense, docs in bitmaps(key[held] >> 16, key[held] & 0xFFFF, rows):
            m = len(pair)
            out = _rows(m, block=np.full(m, block), a=(pair // many).astype(np.int32), b=(pair % many).astype(np.int32), plane=np.full(m, plane, np.int32), n=n.astype(np.int32), dense=np.full(m, dense), docs=docs)
            for at in range(0, m, 20_000):
                yield out.slice(at, 20_000)
        left = more >> plane > 0
        key, more = key[left], more[left]
        held = more >> plane & 1 == 1
        plane += 1


def _index(a_path: str, b_path: str):
    """The rows of the task's documents, and for every block and id pair its bitmaps."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(a_path, b_path)
        table, task, made = WordTable(a, b), TaskContext.get().partitionId(), 0
        rows, size, keys, times = 0, 0, [], []
        for part, texts in slices(batches):
            split = [words_of(t) if t else [] for t in texts]
            table.learn([w for words in split for w in words])
            n = np.array([len(w) for w in split], np.int64)
            codes = np.fromiter((table.number[w] for words in split for w in words), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(texts)), n)
            wrong = np.zeros(len(texts), bool)
            wrong[owner[table.bad[codes]]] = True
            good = ~wrong[owner]
            counts = np.zeros((len(texts), 4), np.int64)
            for k in range(4):
                np.add.at(counts[:, k], owner[good], table.counts[codes[good], k])
            links = table.counts[codes[good], 3]
            key = ragged(table.pairs, table.starts[codes[good]], links) << 16 | np.repeat(owner[good] + rows, links)
            key = np.sort(key)
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            keys.append(key[heads])
            times.append(np.diff(np.append(heads, len(key))))
            written = table.written
            shas, at = [], 0
            for k, m in enumerate(n.tolist()):
                own = b"".join([written[c] for c in codes[at : at + m].tolist()])[:-1] if m and not wrong[k] else b""
                shas.append(hashlib.sha256(own).hexdigest() if own else "")
                at += m
            m = len(texts)
            yield _rows(
                m, block=np.full(m, task << 32 | made), place=np.arange(rows, rows + m, dtype=np.int32), doc_id=part.column(0), n_a=counts[:, 0], n_b=counts[:, 1], n_groups=counts[:, 2], n_links=counts[:, 3], groups_sha256=shas
            )
            rows += m
            size += sum(map(len, texts))
            if size >= BLOCK_CHARS or rows >= BLOCK_ROWS:
                yield from _planes(task << 32 | made, rows, table.many, keys, times)
                made, rows, size, keys, times = made + 1, 0, 0, [], []
                if len(table.number) > MOST_WORDS or table.size > MOST_BYTES:
                    table = WordTable(a, b)
        if rows:
            yield from _planes(task << 32 | made, rows, table.many, keys, times)

    return index


def index_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The stored index: one row per document, and one per block, id pair and plane with a compressed bitmap of the block's documents.

    A document of space + text is cut into words that both tokenizers encode apart; each word of a task is encoded and aligned once. Both paths must be readable by all tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(rows.mapInArrow(_index(a_path, b_path), STORED))


def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs (documents that hold the pair linked), n_links (all links), is_best (no other A id has more links with b).

    Bitmaps of different blocks hold different documents, so their union's bits are counted block by block; plane k counts its bits 2**(k - 1) times.
    """
    weight = F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    summed = index.where("a is not null").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links")
    )
    return summed.withColumn("is_best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal the scores of the pairs to the documents in their bitmaps, a block at a time."""
    block, docs, best, total = None, [], None, None

    def finished() -> pa.Table:
        table = pa.Table.from_batches(docs)
        place = table.column("place").to_numpy()
        out = {k: table.column(k) for k in _DOC} | {"n_best": pa.array(best[place]), "count_sum": pa.array(total[place])}
        return pa.table({k.split()[0]: out[k.split()[0]] for k in RESULT.split(", ")})

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        bounds = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if blocks[start] != block:
                if block is not None:
                    yield from finished().to_batches()
                block, docs, best, total = blocks[start], [], np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            part = batch.slice(start, end - start)
            pairs = part.column("docs").is_valid()
            docs.append(part.filter(part.column("docs").is_null()).select(["place", *_DOC]))
            for dense in (False, True):
                own = part.filter(pc.and_(pairs, pc.equal(part.column("dense"), dense)))
                if not own.num_rows:
                    continue
                weight = np.int64(1) << np.maximum(own.column("plane").to_numpy() - 1, 0).astype(np.int64)
                score, won = own.column("links").to_numpy() * weight, own.column("is_best").to_numpy(zero_copy_only=False) * weight
                if dense:
                    for data, s, w in zip(own.column("docs").to_pylist(), score.tolist(), won.tolist(), strict=True):
                        places = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
                        total[places] += s
                        best[places] += w
                else:
                    n = own.column("n").to_numpy()
                    places = np.frombuffer(b"".join(own.column("docs").to_pylist()), "<u2")
                    np.add.at(total, places, np.repeat(score, n))
                    np.add.at(best, places, np.repeat(won, n))
    if block is not None:
        yield from finished().to_batches()


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a and n_b tokens, n_groups, n_links, n_best, count_sum, groups_sha256.

    A and B tokens are linked where their bytes overlap; groups end where tokens of both end. ``n_best``: links whose pair has as many links in the whole corpus as any with
    its B id; ``count_sum``: the corpus-wide links of the pairs, summed over links. Texts that are NULL, empty or spelled differently by the ids have no tokens: zeros and ''.
    Repeated rows count again; other columns are ignored; an empty table gives no rows. An inverted index holds every pair's documents
    as bitmaps per block; its counts are sums of their bits, and scores return by the bitmaps to the blocks they came from. A
    frequent pair has one row per block and plane, whatever its number of documents.
    """
    index = index_links(docs, a_path, b_path)
    postings = index.where("a is not null").select("block", "a", "b", "plane", "n", "dense", "docs")
    scored = postings.join(pair_counts(index).select("a", "b", F.col("n_links").alias("links"), "is_best"), ["a", "b"])
    rows = index.where("a is null").select("block", "place", *_DOC).unionByName(scored.drop("a", "b"), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_returned, RESULT)
