"""Byte-level BPE: every distinct word of the corpus is encoded once, then the ids return to the words' places."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import slices, sorted_groups

#: Documents of about so many characters form a block, whose distinct words are gathered before the shuffle.
BLOCK_CHARS = 12_000_000
_ODD_BLANKS = re.compile(r"\s\s|\A | \Z")
_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in a row, and the start and length of each id."""
    table = ranks(path)
    size = max(table.values()) + 1
    lengths = np.zeros(size, np.int64)
    parts = [b""] * size
    for token, i in table.items():
        parts[i], lengths[i] = token, len(token)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def words_of(text: str) -> list:
    """Words that are encoded apart: cut at every single blank between two non-blanks, the blank goes to the word after it.

    No match of the pattern spans such a place: a blank ends any match before it, and the match that starts at it takes it along.
    The first word is wrapped in a tuple, the others lack their leading blank.
    """
    if not text:
        return []
    parts = _INNER_BLANK.split(text) if _ODD_BLANKS.search(text) else text.split(" ")
    parts[0] = (parts[0],)
    return parts


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=9).compress(data, asbytes=True)


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(4, "little") + (_squeezed(planes.tobytes()) if len(x) else b"")


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:4], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(x[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


WORDS = "block long, bucket int, words binary, sizes binary, counts binary, firsts binary, gaps binary, doc_ids array<long>, doc_words array<long>"
CODED = "block long, ids binary, sizes binary, counts binary, firsts binary, gaps binary, doc_ids array<long>, doc_words array<long>"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _gather(buckets: int):
    """Distinct words of each block with their positions, one row per bucket of words, and one row with the block's documents."""

    def block_rows(block: int, numbers: dict, places: list[np.ndarray], docs: list[tuple]) -> pa.RecordBatch:
        codes = np.concatenate(places) if places else np.zeros(0, np.int32)
        words = [w[0].encode("utf-8", "surrogatepass") if isinstance(w, tuple) else b" " + w.encode("utf-8", "surrogatepass") for w in numbers]
        home = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(words))
        starts = np.cumsum(counts) - counts
        rows = [(block, block % buckets, None, None, None, None, None, [d for d, _ in docs], [n for _, n in docs])]
        by_home = np.argsort(home, kind="stable")
        for own in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1) if len(words) else []:
            # Numbers rise with the first place, so first places are stored as steps from word to word.
            spots = ragged(order, starts[own], counts[own])
            heads = np.cumsum(counts[own]) - counts[own]
            steps = np.diff(spots, prepend=0)
            firsts = spots[heads]
            rows.append((
                block, int(home[own[0]]), _squeezed(b"".join([words[i] for i in own.tolist()])), _packed(sizes[own]), _packed(counts[own]),
                _packed(np.diff(firsts, prepend=0)), _packed(np.delete(steps, heads)), None, None,
            ))
        return _batch(rows, WORDS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def fresh():
            numbers: dict = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers, [], [], 0

        numbers, places, docs, size = fresh()
        for part, texts in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                codes = list(map(numbers.__getitem__, words_of(text)))
                places.append(np.array(codes, np.int32))
                docs.append((doc_id, len(codes)))
                size += len(text)
            if size >= BLOCK_CHARS:
                yield block_rows(task << 32 | made, numbers, places, docs)
                made += 1
                numbers, places, docs, size = fresh()
        if docs:
            yield block_rows(task << 32 | made, numbers, places, docs)

    return gather


def _encode(path: str, pattern: str):
    """Encode each distinct word that reaches the task once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        known: dict[bytes, bytes] = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["words"] is None:
                    rows.append((r["block"], None, None, None, None, None, r["doc_ids"], r["doc_words"]))
                    continue
                ends = np.cumsum(_unpacked(r["sizes"])).tolist()
                text = pa.decompress(r["words"], ends[-1], "zstd", asbytes=True) if ends[-1] else b""
                ids, start = [], 0
                for end in ends:
                    word = text[start:end]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(coder.encode_ordinary(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                    ids.append(got)
                    start = end
                flat = np.frombuffer(b"".join(ids), "<u4")
                sizes = np.array([len(x) // 4 for x in ids])
                rows.append((r["block"], _packed(flat), _packed(sizes), r["counts"], r["firsts"], r["gaps"], None, None))
            if rows:
                yield _batch(rows, CODED)

    return encode


def _bytes_of(ids: np.ndarray, path: str) -> bytes:
    """The bytes of the ids in a row, looked up in the token-byte table."""
    data, starts, lengths = token_bytes(path)
    return ragged(data, starts[ids], lengths[ids]).tobytes()


def _reassemble(batches: Iterator[pa.RecordBatch], decode: str | None = None) -> Iterator[pa.RecordBatch]:
    """Put the ids of a block's words back in place and cut them by document; with a path also their bytes."""
    names = ["doc_id", "ids"] + ["decoded"] * bool(decode)

    def batch(ids: list, encoded: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), pa.array(encoded, pa.binary())]
        if decode:
            columns.append(pa.array([_bytes_of(np.frombuffer(x, "<u4"), decode) for x in encoded], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names)

    for group in sorted_groups(batches, ["block"]):
        rows = group.to_pylist()
        docs = next(r for r in rows if r["doc_ids"] is not None)
        flat, sizes, spots, owners, seen = [], [], [], [], 0
        for r in rows:
            if r["ids"] is None:
                continue
            counts, gaps = _unpacked(r["counts"]), _unpacked(r["gaps"])
            heads = np.cumsum(counts) - counts
            steps = np.zeros(int(counts.sum()), np.int64)
            rest = np.ones(len(steps), bool)
            rest[heads] = False
            steps[rest] = gaps
            run = np.cumsum(steps)
            spots.append(run + np.repeat(np.cumsum(_unpacked(r["firsts"])) - run[heads], counts))
            owners.append(np.repeat(np.arange(seen, seen + len(counts)), counts))
            seen += len(counts)
            flat.append(_unpacked(r["ids"]))
            sizes.append(_unpacked(r["sizes"]))
        if flat:
            flat, sizes = np.concatenate(flat).astype("<u4"), np.concatenate(sizes)
            word_at = np.empty(sum(map(len, spots)), np.int64)
            word_at[np.concatenate(spots)] = np.concatenate(owners)
            starts = np.cumsum(sizes) - sizes
        else:
            flat, sizes, word_at, starts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        ids, encoded, waiting = [], [], 0
        for doc_id, n in zip(docs["doc_ids"], docs["doc_words"], strict=True):
            own = word_at[at : at + n]
            at += n
            ids.append(doc_id)
            encoded.append(ragged(flat, starts[own], sizes[own]).tobytes())
            waiting += len(encoded[-1])
            if waiting > 4_000_000:
                yield batch(ids, encoded)
                ids, encoded, waiting = [], [], 0
        if ids:
            yield batch(ids, encoded)


def encode_documents(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit) of every text, and with ``decoded`` the bytes that the ids stand for; NULL texts are empty and have no ids, repeated rows are kept.

    Three steps: blocks of documents give their distinct words with positions, dealt by word; each word is encoded once where all blocks'
    copies of it meet; ids and positions are dealt back by block. A word is sent once per block, however often it occurs, so
    frequent words cannot overload a task. ``path`` must be readable by all tasks.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = rows.mapInArrow(_gather(buckets), WORDS).repartition("bucket")
    coded = words.mapInArrow(_encode(path, pattern), CODED).repartition("block").sortWithinPartitions("block")
    decode = path if decoded else None
    return coded.mapInArrow(lambda rows: _reassemble(rows, decode), "doc_id long, ids binary" + ", decoded binary" * decoded)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (the bytes of the ids in a row) by joining the token-byte table, a fixed table every task holds."""
    own = encoded.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_bytes_of(np.frombuffer(x.as_py() or b"", "<u4"), path) for x in batch.column(own.index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*own, "decoded"])

    return encoded.mapInArrow(decode, ", ".join(f"`{n}` {k}" for n, k in [*encoded.dtypes, ("decoded", "binary")]))


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded bytes of every document."""
    decoded = encode_documents(docs, path, pattern, decoded=True)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
