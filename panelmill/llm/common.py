"""Helpers of the corpus operators: word hashes in NumPy, streams of sorted rows, label samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Texts are handled in slices of about so many characters, which bounds the memory of a task.
SLICE_CHARS = 1 << 19

_POWERS: dict[int, np.ndarray] = {}
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # Not every system's library has it.
    _LIBC = None


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; grown by doubling and kept for the task's process."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit hashes (that of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(is_word) -> np.ndarray:
    """Table of 256: the byte a word keeps (A-Z lowered), 0 for bytes between words."""
    return np.array([(b + 32 if 65 <= b <= 90 else b) if is_word(b) else 0 for b in range(256)], np.uint8)


#: Words are what lies between ASCII blanks.
BLANK_SEPARATED = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words are runs of ASCII letters, digits and all bytes beyond ASCII.
ALNUM = byte_table(lambda b: b >= 128 or chr(b).isalnum())


class Words:
    """Word hashes of a slice of texts.

    ``hashes``: one 64-bit hash per word; ``bounds``: text i has the words ``bounds[i]:bounds[i+1]``.
    A byte 0 inside a word is hashed as 0 + 1 like any other, so it does not end the word.
    """

    def __init__(self, texts: list[str], table: np.ndarray):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        low = table[raw]
        inside = (low != 0) | ((raw == 0) & (table[1] != 0))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=self.prefix[1:])
        self.hashes = self.span(self.starts, self.ends)
        self.text_ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, self.text_ends)]).astype(np.int64)

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans; they depend on the content alone."""
        back = powers(BASE_INVERSE, len(self.prefix))[starts]
        length = (ends - starts).astype(np.uint64)
        return mix((self.prefix[ends] - self.prefix[starts]) * back + length * np.uint64(0xD6E8FEB86659FD93))

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of each word."""
        return self.span(self.starts, np.minimum(self.ends, self.starts + n))


def release() -> None:
    """Give memory that is free within this Python worker back to the system. Workers are kept from task to task, and so is what their allocators hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def score_texts(score: Callable[[list[str]], np.ndarray], chars: int = SLICE_CHARS // 4) -> Column:
    """The column ``text`` scored by ``score``, in slices of about ``chars``. Only texts go to Python and only numbers come back; other columns stay in the JVM."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [score(texts) for _, texts in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), chars=chars)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    # Annotations are text in this module; the kind of function is told by them.
    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "double")(F.col("text"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of about ``chars``; a NULL text counts as empty. A text is never cut."""
    release()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.utf8_length(column).fill_null(0).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + chars, side="right")))
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in column.slice(start, end - start).to_pylist()]
            start = end
    release()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from a stream that is sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        values = list(zip(*columns, strict=True))
        start = 0
        for i, value in enumerate(values):
            if last is not None and value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
            last = value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def known_labels(labels: DataFrame, label: str, where: Column) -> DataFrame:
    """doc_id and label of all labelled ids that ``where`` allows. Contradicting labels take the majority (a tie counts as 1)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    return known.where(where).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column, extra: tuple = ()) -> DataFrame:
    """At most ``rows`` labelled texts, drawn by a hash of the id: columns doc_id, text, label and ``extra``.

    ``where`` filters the labels by doc_id. Ids with contradicting labels take the majority (a tie counts as 1).
    The drawn ids are at most ``rows``, so sending them to all tasks is bounded by that parameter.
    """
    drawn = known_labels(labels, label, where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)
    return texts.join(F.broadcast(drawn), "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
