"""Packing of documents into sequences by deficit round-robin over the sources."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelmill.llm.common import SLICE_CHARS, release, slices
from panelmill.operators.running import running_totals
from panelmill.session import cut_lineage

SEQUENCE = 4096
#: Sequences per window: within it every source gets its share of tokens.
WINDOW = 16
#: Documents that a task cuts into pieces at once: the rest of an Arrow batch stays in its buffers.
CUT_ROWS = 512


#: What a file must ask for, so that words between blanks are encoded independently and the tables below hold.
# The normalisers and the pieces that the tokenizer's file names.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer as it is. A file that normalises or cuts differently is refused: its words could not be encoded apart."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = Tokenizer.from_file(path)
    kind = json.loads(loaded.to_str())
    if kind["normalizer"] != _NORMALIZER or kind["pre_tokenizer"] != _PIECES or not kind["model"].get("end_of_word_suffix"):
        raise ValueError(f"{path} does not lower and cut words as packing expects")
    return loaded


@lru_cache(maxsize=2)
def markers(path: str) -> re.Pattern:
    """The strings of the file's added tokens, which stand for one id wherever a text holds them."""
    added = [re.escape(t["content"]) for t in json.loads(tokenizer(path).to_str())["added_tokens"]]
    return re.compile("|".join(sorted(added, key=len, reverse=True)) or r"(?!)")


#: Texts of these characters alone are lowered and cut into pieces here; the tokenizer itself encodes all others. None of them changes under
#: normalisation, and their lower case does not depend on their neighbours.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\u00a1-\u012f\u0131-\u017f]*")
_PIECE = regex.compile(_PATTERN)
#: Stands for the end of a word in the merge table; no UTF-8 text holds this byte.
_END = b"\xff"


@lru_cache(maxsize=2)
def piece_merges(path: str) -> tiktoken.Encoding:
    """The vocabulary as a table of byte strings by rank: merges rank by id, and the end of a word is a byte that is merged first."""
    loaded = tokenizer(path)
    suffix = json.loads(loaded.to_str())["model"]["end_of_word_suffix"]
    # Vocabulary files write printable bytes as themselves and the others, in order, as the characters from 256 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    table = {}
    for token, number in loaded.get_vocab(with_added_tokens=False).items():
        core = token.removesuffix(suffix)
        if all(c in byte_of for c in core) and not (token.startswith("<|") and token.endswith("|>")):
            table[bytes(byte_of[c] for c in core) + (_END if core != token else b"")] = number
    return tiktoken.Encoding("pieces", pat_str=r"[^\x00]+", mergeable_ranks=table, special_tokens={})


class WordCache:
    """Ids of texts from those of their blank-separated words, which the tokenizer encodes independently of each other."""

    def __init__(self, path: str, limit: int = 400_000):
        self.path, self.limit, self.words = path, limit, {}
        self.kind = "<u2" if tokenizer(path).get_vocab_size() <= 2**16 else "<u4"

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def _learn(self, keys: list) -> None:
        """Keep the ids of words: strings of plain characters in lower case, and others in tuples, as they are."""
        unknown = [w for w in keys if w not in self.words]
        if len(self.words) + len(unknown) > self.limit:
            self.words, unknown = {}, keys
        words, merge = self.words, piece_merges(self.path)._core_bpe.encode_single_piece
        for word in unknown:
            if not isinstance(word, str):
                continue
            if word.isalpha():
                words[word] = self._packed(merge(word.encode() + _END))
                continue
            parts = []
            for piece in _PIECE.findall(word):
                got = words.get(piece)
                if got is None:  # A piece alone is a word of one piece.
                    got = words[piece] = self._packed(merge(piece.encode() + _END))
                parts.append(got)
            words[word] = b"".join(parts)
        other = [w for w in unknown if isinstance(w, tuple)]
        for word, got in zip(other, tokenizer(self.path).encode_batch_fast([w for w, in other], add_special_tokens=False), strict=True):
            words[word] = self._packed(got.ids)

    def _join(self, texts: list[str], plain: bool, last: bytes) -> list[bytes]:
        """The words of all texts are numbered by Arrow, so each distinct one is looked up once, and NumPy puts the ids together."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        keys = keys if plain else [(w,) for w in keys]
        self._learn(keys)
        found = [self.words[w] for w in keys]
        ids = np.frombuffer(b"".join(found), self.kind)
        sizes = np.array([len(x) for x in found], np.int64) // ids.itemsize
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        # From a word's place in the stream to that in the table.
        places = np.repeat(((np.cumsum(sizes) - sizes)[codes] - ends[:-1]).astype(np.int32 if ends[-1] < 2**31 else np.int64), counts)
        places += np.arange(len(places), dtype=places.dtype)
        stream = ids[places]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [stream[i:j].tobytes() + last for i, j in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """The ids of every text, and ``end`` behind them if given, as numbers of ``kind``."""
        marker, last = markers(self.path).search, b"" if end is None else self._packed([end])
        plain = [bool(_PLAIN.fullmatch(t)) and not marker(t) for t in texts]
        done: list[bytes] = [b""] * len(texts)
        for kind in {*plain}:
            places = [i for i, p in enumerate(plain) if p == kind]
            ready = []
            for text in map(texts.__getitem__, places):
                for blank in "\t\n\r\x0b\x0c":
                    text = text.replace(blank, " ")
                ready.append(text.lower() if kind else text)
            for i, ids in zip(places, self._join(ready, kind, last), strict=True):
                done[i] = ids
        return done


def tokenise(docs: DataFrame, path: str, end: int) -> DataFrame:
    """uid, doc_id, source, n, ids of all rows, stored once. ``end`` closes every document; ``uid`` names the row within the stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task, seen = WordCache(path), TaskContext.get().partitionId(), 0
        width = np.dtype(cache.kind).itemsize
        for part, texts in slices(batches, chars=SLICE_CHARS // 2):
            ids = cache.encode(texts, end)
            uids = (task << 40) + seen + np.arange(len(ids))
            seen += len(ids)
            counts = [len(x) // width for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["uid", "doc_id", "source", "n", "ids"]
            )

    source = (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("source")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, "text")
    return cut_lineage(rows.mapInArrow(run, "uid long, doc_id long, source string, n long, ids binary"))


def deficit_round_robin(rows: DataFrame, window: int, mixture: dict[str, float] | None = None) -> DataFrame:
    """Add ``at``: the place of each row's first token in the packed stream. ``rows``: uid, doc_id, source, n (tokens, at least 1).

    Every round offers each source its quantum, ``window`` tokens times its target share; a source serves its next document while
    it has credit, and what the last one takes beyond it is carried as a deficit into the next rounds. So a document whose
    source has sent s tokens before it is served in round floor(s / quantum): rounds need no loop, and deficits pass over
    partition bounds by themselves. An empty queue drops out. Shares: ``mixture`` (missing sources: 0, served last)
    or, by default, the sources' own shares of all tokens, so that all queues end together. A NULL source is a queue of its own.
    """
    totals = rows.groupBy("source").agg(F.sum("n").alias("_all"))
    if mixture is None:
        total = rows.agg(F.sum("n")).first()[0] or 1
        shares = totals.select(F.col("source").alias("_source"), (F.col("_all") / F.lit(total)).alias("_share"))
    else:
        goal = sum(mixture.values())
        named = F.element_at(F.create_map(*[F.lit(x) for k, v in mixture.items() for x in (k, float(v) / goal)]), F.col("source"))
        shares = totals.select(F.col("source").alias("_source"), F.coalesce(named, F.lit(0.0)).alias("_share"))
    queued = running_totals(rows, ["source"], ["doc_id", "uid"], "n", "_sent")
    placed = queued.join(shares, F.col("source").eqNullSafe(F.col("_source")))
    last = F.lit(2**62)
    turn = F.when(F.col("_share") > 0, F.floor(F.col("_sent") / (F.col("_share") * window))).otherwise(last)
    placed = placed.select("uid", "doc_id", "source", "n", turn.cast("long").alias("_round"), "_sent")
    return running_totals(placed, [], ["_round", "source", "_sent", "uid"], "n", "at").select("uid", "doc_id", "source", "n", F.col("_round").alias("round"), "at")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(sequence: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECE.split(", ")]
        kinds = [pa.int64()] * len(names)
        release()
        for batch in (b.slice(i, CUT_ROWS) for b in batches for i in range(0, b.num_rows, CUT_ROWS)):
            rows = []
            for doc_id, n, at, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")
                start = 0
                while start < n:
                    number, offset = divmod(at + start, sequence)
                    length = min(n - start, sequence - offset)
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, number, offset))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return cut


def pack_documents(docs: DataFrame, path: str, end: int = 2, sequence: int = SEQUENCE, window: int = WINDOW, mixture: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text, source) in sequences of ``sequence`` tokens, mixed by source (``deficit_round_robin``).

    The documents form one stream that is cut at every ``sequence`` tokens, so only the last sequence is not full. NULL texts are empty and
    hold the end id alone; repeated rows are packed one by one; other columns are ignored; an empty table gives no pieces. Token
    ids are stored once and sent once, to meet their places; places come from two prefix sums over small rows.
    """
    tokens = tokenise(docs, path, end)
    places = deficit_round_robin(tokens.select("uid", "doc_id", "source", "n"), sequence * window, mixture)
    joined = tokens.select("uid", "doc_id", "n", "ids").join(places.select("uid", "at"), "uid")
    return joined.select("doc_id", "n", "at", "ids").mapInArrow(_cut(sequence), PIECE)
