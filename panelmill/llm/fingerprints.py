"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import slices

#: Mersenne prime: a product of two residues fits 64 bits and is reduced by shifts.
PRIME = np.uint64(2**31 - 1)
SHIFT = np.uint64(31)
BASES = (1_000_003 * 1201 % (2**31 - 1), 998_244_353)
#: Length of the spans that a fingerprint samples, and how many of their smallest hashes it keeps.
SPAN, SKETCH = 32, 64
#: Lengths at which a fingerprint keeps the hashes of the prefix and of the suffix.
GRID = sorted({round(1.5**k) for k in range(60)})

_TABLES: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """A residue below 2**33 of a number below 2**64."""
    return (x & PRIME) + (x >> SHIFT)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    x[x == PRIME] = 0
    return x


def _table(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo the prime, grown by doubling."""
    have = _TABLES.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _reduce(have * np.uint64(pow(base, len(have), int(PRIME))))])
    _TABLES[base] = have
    return have[:n]


class PrefixHashes:
    """Prefix arrays of a text: any two spans, of any texts, are compared in constant time by their hashes."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = len(self.codes)
        self.known: dict[int, np.ndarray] = {}

    def prefix(self, which: int) -> np.ndarray:
        """Prefix array under one base, made when first asked for."""
        if which not in self.known:
            p = np.zeros(self.size + 1, np.uint64)
            # A code below 2**21 times a residue folds below 2**32, so sums stay below 2**64 up to 2**32 characters.
            np.cumsum(_folded(self.codes * _table(BASES[which], self.size)), out=p[1:])
            self.known[which] = _reduce(p)
        return self.known[which]

    def spans(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the spans [start, end) under one base; they do not depend on the place."""
        p = self.prefix(which)
        inverse = pow(BASES[which], -1, int(PRIME))
        return _reduce((p[ends] + PRIME - p[starts]) * _table(inverse, self.size + 1)[starts])

    def span(self, start: int, end: int) -> int:
        """62-bit hash of one span."""
        if start == 0 and end == self.size and 1 not in self.known:
            # The whole text needs the sum alone.
            total = np.array([_folded(self.codes * _table(BASES[1], self.size)).sum(dtype=np.uint64)])
            return int(self.spans(np.array([0]), np.array([end]), 0)[0]) << 31 | int(_reduce(total)[0])
        a, b = np.array([start]), np.array([end])
        return int(self.spans(a, b, 0)[0]) << 31 | int(self.spans(a, b, 1)[0])


def span_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether a[i:i+length] equals b[j:j+length] (up to a collision of 62-bit hashes)."""
    return i + length <= a.size and j + length <= b.size and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension of a[i:] and b[j:], by binary search over span equality."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i + low, i + middle) == b.span(j + low, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def fingerprint(text: str) -> str:
    """Hex fields: length, 62-bit hash, prefix hashes at the grid lengths, suffix hashes there, smallest span hashes.

    Equal texts have equal fingerprints. The size is bounded (about 900 characters), whatever the text's length.
    """
    h = PrefixHashes(text)
    grid = np.array([g for g in GRID if g <= h.size], np.int64)
    zero = np.zeros(len(grid), np.int64)
    width = min(SPAN, h.size)
    starts = np.arange(h.size - width + 1 if h.size else 0)
    # Multiplying by an odd constant orders the spans at random while keeping their hashes distinct.
    order = (h.spans(starts, starts + width, 0) * np.uint64(2654435761)).astype(np.uint32)
    fields = [h.spans(zero, grid, 0), h.spans(h.size - grid, np.full(len(grid), h.size), 0), _smallest(order, SKETCH)]
    return f"{h.size:x}-{h.span(0, h.size):016x}-" + "-".join(x.astype(">u4").tobytes().hex() for x in fields)


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` smallest distinct values, sorted."""
    if len(values) > 8 * n:
        few = np.unique(np.partition(values, 2 * n)[: 2 * n])
        if len(few) >= n:
            return few[:n]
    return np.unique(values)[:n]


def _fields(fp: str) -> tuple[int, list[np.ndarray]]:
    size, _, *rest = fp.split("-")
    return int(size, 16), [np.frombuffer(bytes.fromhex(x), ">u4") for x in rest]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Longest grid length at which two lists of nested hashes agree, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return GRID[low - 1] if low else 0


def likeness(a: str, b: str) -> float:
    """Likeness of two texts from their fingerprints, 0 to 1 (equal fingerprints: 1).

    The larger of two estimates of shared / all characters: the resemblance of the sampled spans, which finds moved
    passages, and the common prefix plus suffix located on the grid.
    """
    if a == b:
        return 1.0
    (n, (pa_, sa, ka)), (m, (pb, sb, kb)) = _fields(a), _fields(b)
    if not n or not m:
        return 0.0
    both = np.sort(np.concatenate([ka, kb]).astype(np.uint32))
    twice = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(twice)
    # Among the smallest of the union, those that both have.
    last = both[-1] if union <= SKETCH else np.unique(both)[SKETCH - 1]
    alike = int(np.searchsorted(twice, last, side="right")) / min(union, SKETCH)
    shared = min(_agree(pa_, pb) + _agree(sa, sb), n, m)
    return float(min(1.0, max(alike, shared / (n + m - shared))))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form (see ``edited``), where the following document is the next by descending
    doc_id; after the last comes the first.

    NULL texts are empty, NULL ids come last, rows of equal id are ordered by text; other columns are ignored; an empty table gives no rows.
    Texts are dealt once, into ranges of doc_id whose bounds come from a quantile sketch of the ids. The first document of each range is
    sent to the range before it as well, so that every task finds the following texts next to each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count)
    bounds = np.array(sorted({int(x) for x in cuts}), np.int64)

    def ranges(column: pa.Array) -> np.ndarray:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        place = len(bounds) - np.searchsorted(bounds, column.fill_null(0).to_numpy(), side="left")
        return np.where(known, place, len(bounds))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.table({"r": ranges(batch.column(0)), "doc_id": batch.column(0)}).group_by("r").aggregate([("doc_id", "max")])
            yield from data.rename_columns(["r", "doc_id"]).to_batches()

    # One row per range: bounded by the number of partitions.
    firsts = {r["r"]: r["doc_id"] for r in ids.mapInArrow(largest, "r long, doc_id long").groupBy("r").agg(F.max("doc_id").alias("doc_id")).collect()}
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["r", "guest", "doc_id", "text"]
        for batch in batches:
            place = ranges(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.zeros(len(place), np.int32)), *batch.columns], names)
            first = [i for i, (r, d) in enumerate(zip(place.tolist(), batch.column(0).to_pylist(), strict=True)) if firsts[r] == d]
            if first:
                part = batch.take(pa.array(first))
                home = pa.array([before[r] for r in place[first].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([home, pa.array(np.ones(len(first), np.int32)), *part.columns], names)

    dealt = rows.mapInArrow(deal, "r long, guest int, doc_id long, text string").repartition("r")
    dealt = dealt.sortWithinPartitions("r", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return dealt.mapInArrow(_walk, RESULT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (range, doc_id, text, fingerprint) that waits for the text after it
    names = [c.split()[0] for c in RESULT.split(", ")]
    for part, texts in slices(batches):
        out: list[tuple] = []
        for r, guest, doc_id, text in zip(*[part.column(i).to_pylist() for i in range(3)], texts, strict=True):
            if guest and (held is None or held[0] != r):
                continue  # a further row with the id of the first one
            own = fingerprint(text)
            if held is not None and held[0] == r:
                _, i, t, fp = held
                changed = edited(t, text)
                other = fingerprint(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((i, len(t), digest, fp, other, likeness(fp, other), likeness(fp, own)))
            held = None if guest else (r, doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*out, strict=True))], names)
