"""Line dedup: a segment-partition edit join with banded bit-parallel verification."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelmill.llm.blocks import id_filter, joined_already, link_blocks, passes
from panelmill.llm.common import BASE, BASE_INVERSE, mix, powers, slices
from panelmill.llm.graph import Forest, connected_components
from panelmill.session import cut_lineage

#: Length from which so many edits are allowed, for the shorter line of a pair. Shorter lines are left alone.
EDITS = ((20, 1), (40, 2))
#: The same, and lines of 1 to 19 characters at distance 0.
ALL_LINES = ((1, 0), *EDITS)


#: What makes a line blank.
BLANKS = " \t\r\x0b\x0c\u00a0\u3000"


def allowed(length: int, edits=EDITS) -> int:
    """Edits allowed for a pair whose shorter line has this length; -1: lines of this length are not compared."""
    return max([k for least, k in edits if length >= least], default=-1)


def cuts(length: int, edits: int) -> list[int]:
    """Bounds of the ``edits`` + 1 segments of a line."""
    return [i * length // (edits + 1) for i in range(edits + 2)]


def window(i: int, start: int, size: int, length: int, gap: int, edits: int) -> range:
    """Where segment i (from ``start``, of ``size``) of a line that is ``gap`` shorter may lie in a line of ``length``.

    Of several shared segments at least one has at most i edits before it and ``edits`` - i behind it, which bounds its shift
    seen from either end.
    """
    low = max(0, start - i, start + gap - (edits - i))
    return range(low, min(length - size, start + i, start + gap + edits - i) + 1)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two texts is at most ``k``: bit-parallel over a band of 2k + 1 diagonals.

    What both have in common at the ends is taken off first. The band of column j holds the rows j-k .. j+k; its bits say where the
    distance rises (``up``) or falls (``down``) from row to row. The distance is followed along the lowest diagonal of the band, then along the last row.
    """
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    start, least = 0, min(len(a), len(b))
    step = 1 << max(0, least.bit_length() - 1)
    while step:
        if start + step <= least and a[start : start + step] == b[start : start + step]:
            start += step
        else:
            step >>= 1
    end, step, most = 0, 1 << max(0, least.bit_length() - 1), least - start
    while step:
        if end + step <= most and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end += step
        else:
            step >>= 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n) <= k
    width = 2 * k + 1
    full = (1 << width) - 1
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    # Bits stand for the rows of the coming column; from row 1 on, the first column rises by one from row to row.
    up, down, distance = full >> k << k, 0, min(k, m)
    for j in range(1, n + 1):
        shift = j - k - 1  # character of the band's first row
        match = (places[b[j - 1]] >> shift if shift >= 0 else places[b[j - 1]] << -shift) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        rise = (down | ~(zero | up)) & full
        fall = zero & up
        if j + k <= m:
            distance += 0 if zero >> (width - 1) & 1 else 1
        else:
            row = m - (j - k)
            distance += (rise >> row & 1) - (fall >> row & 1)
        if distance > k + n - j:
            return False
        moved = zero >> 1
        up = (fall | ~(moved | rise)) & full
        down = moved & rise
    return distance <= k


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def line_ids(lines: list[str]) -> list[tuple[int, int]]:
    """Two 63-bit numbers that name a line's content."""
    out = []
    for line in lines:
        d = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        out.append((int.from_bytes(d[:8], "little") >> 1, int.from_bytes(d[8:], "little") >> 1))
    return out


def segment_keys(lines: list[str], edits=EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines' segments and of the substrings that may equal a segment of a line that is no longer.

    Returns the key, the number of the line, and whether it is a segment (True) or a probe. Keys hold the segment's text, number and line length.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=prefix[1:])
    back = powers(BASE_INVERSE, len(codes) + 1)
    size = np.array([len(x) for x in lines], np.int64)
    origin = np.cumsum(size) - size
    rank = np.full(len(lines), -1, np.int64)
    for least, k in sorted(edits):
        rank[size >= least] = k
    keys, owners, kinds = [], [], []

    def add(own: np.ndarray, starts: np.ndarray, length: np.ndarray, line: np.ndarray, i: int, segment: bool) -> None:
        at = origin[own] + starts
        span = (prefix[at + length] - prefix[at]) * back[at]
        keys.append(mix(mix(span) + line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1)))
        owners.append(own)
        kinds.append(np.full(len(own), segment))

    for k in sorted({k for _, k in edits}):
        own = np.flatnonzero(rank == k)
        for i in range(k + 1):
            low, high = i * size[own] // (k + 1), (i + 1) * size[own] // (k + 1)
            add(own, low, high - low, size[own], i, True)
        for gap in range(k + 1):
            # Lines that are ``gap`` longer than a line with ``k`` allowed edits.
            shorter = size - gap
            fits = np.full(len(lines), -1, np.int64)
            for least, e in sorted(edits):
                fits[shorter >= least] = e
            own = np.flatnonzero(fits == k)
            line = shorter[own]
            for i in range(k + 1):
                start, stop = i * line // (k + 1), (i + 1) * line // (k + 1)
                for shift in range(max(-i, gap - (k - i)), min(i, gap + k - i) + 1):
                    if gap == 0 and shift == 0:
                        continue  # the segment itself
                    ok = (start + shift >= 0) & (stop + shift <= size[own])
                    add(own[ok], (start + shift)[ok], (stop - start)[ok], line[ok], i, False)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)


def join_lines(nodes: list[int], texts: list[str], side: np.ndarray, components: list[int], edits=EDITS) -> list[tuple[int, int]]:
    """Edges between lines within their allowed distance; pairs already joined through others are passed over."""
    forest, edges = Forest(), []
    joined_already(forest, nodes, components)
    index: dict[tuple, list[int]] = defaultdict(list)
    lengths = {len(t) for t in texts}
    for b in sorted(range(len(texts)), key=lambda i: (len(texts[i]), nodes[i])):
        text, n = texts[b], len(texts[b])
        tried = set()
        for line in range(max(0, n - max(k for _, k in edits)), n + 1):
            k = allowed(line, edits)
            if line not in lengths or n - line > k:
                continue
            bounds = cuts(line, k)
            for i in range(k + 1):
                start, length = bounds[i], bounds[i + 1] - bounds[i]
                for at in window(i, start, length, n, n - line, k):
                    for a in index.get((line, i, text[at : at + length]), ()):
                        if a in tried or not (side[a] or side[b]) or forest.root(nodes[a]) == forest.root(nodes[b]):
                            continue
                        tried.add(a)
                        if within(texts[a], text, k):
                            forest.join(nodes[a], nodes[b])
                            edges.append((nodes[a], nodes[b]))
        k = allowed(n, edits)
        if k >= 0:
            bounds = cuts(n, k)
            for i in range(k + 1):
                index[n, i, text[bounds[i] : bounds[i + 1]]].append(b)
    return edges


def _keys(least: int, edits):
    """(key, line) of every distinct line of a task; segments are negative, so they sort before the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in slices(batches):
            lines = list({x for t in texts for x in lines_of(t) if len(x) >= least})
            ids = [a for a, _ in line_ids(lines)]
            fresh = [i for i, v in enumerate(ids) if v not in seen]
            seen.update(ids)
            key, own, segment = segment_keys([lines[i] for i in fresh], edits)
            node = np.array([ids[i] for i in fresh], np.int64)[own]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.where(segment, ~node, node))], ["key", "v"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, v) sorted by both: edges from the first segment of each key to its other lines."""
    last_key, lead = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        leads = v[head]
        if key[0] == last_key:
            leads[: int(np.searchsorted(key != key[0], True)) if (key != key[0]).any() else len(key)] = lead
        last_key, lead = key[-1], leads[-1]
        node, first = np.where(v < 0, ~v, v), ~leads
        keep = (leads < 0) & (node != first)
        yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(node[keep])], ["a", "b"])


OCCURRENCES = "doc_id long, doc_key long, line int, a long, b long"


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            own, place, a, b, keys = [], [], [], [], []
            for i, (text, key) in enumerate(zip(texts, document_keys(texts), strict=True)):
                spots = [(j, x) for j, x in enumerate(lines_of(text)) if len(x) >= least]
                for (j, _), (x, y) in zip(spots, line_ids([x for _, x in spots]), strict=True):
                    own.append(i)
                    place.append(j)
                    a.append(x)
                    b.append(y)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(own, pa.int64())), pa.array(keys, pa.int64()), pa.array(place, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                ["doc_id", "doc_key", "line", "a", "b"],
            )

    return run


def document_keys(texts: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 for t in texts]


def repeated_lines(docs: DataFrame, edits=EDITS) -> DataFrame:
    """doc_id, doc_key (of the text) and ``lines`` (numbers from 0) of the repeated lines of each document that has some.

    Lines are compared if they have at least the shortest length of ``edits``; where that allows no edit, by their ids alone. Two lines are linked if they are equal or their edit distance
    (in code points) is at most that allowed for the shorter one; the classes are the connected components. The first line of a class by
    (doc_id, text hash, place) stays, all others are repeated. Rows of equal id and text count as one document. A NULL id sorts first.

    Segments and probes of a task's distinct lines are dealt by key; lines that share one, directly or in chains, form a block, whose texts
    meet once and are joined exactly. Frequent lines are joined by their content before, so their number does not matter.
    """
    least, near = min(n for n, _ in edits), min([n for n, k in edits if k], default=1 << 31)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = cut_lineage(rows.mapInArrow(_occurrences(least), OCCURRENCES))
    keys = rows.select("text").mapInArrow(_keys(near, edits), "key long, v long")
    stars = keys.repartition("key").sortWithinPartitions("key", "v").mapInArrow(_stars, "a long, b long")
    blocks = cut_lineage(connected_components(stars).select("node", F.col("component").alias("block")))
    table = docs.sparkSession.sparkContext.broadcast(id_filter(blocks.select("node")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in slices(batches):
            found = list({x for t in texts for x in lines_of(t) if len(x) >= near})
            ids = np.array([a for a, _ in line_ids(found)], np.int64)
            fresh = [i for i in np.flatnonzero(passes(table.value, ids)).tolist() if int(ids[i]) not in seen]
            seen.update(ids[fresh].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array([found[i] for i in fresh], pa.string())], ["node", "text"])

    texts = rows.select("text").mapInArrow(fetch, "node long, text string").join(blocks, "node").groupBy("node", "block").agg(F.min("text").alias("text"))
    found = connected_components(link_blocks(texts.select("node", "block", "text"), lambda n, t, s, c: join_lines(n, t, s, c, edits)))
    named = lines.join(found, F.col("a") == F.col("node"), "left").select(
        "doc_id", "doc_key", "line", F.coalesce("component", "a").alias("a"), F.when(F.col("component").isNull(), F.col("b")).otherwise(0).alias("b")
    )
    spot = F.struct("doc_id", "doc_key", "line")
    classes = named.groupBy("a", "b").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last")
    again = named.join(classes.drop("last"), ["a", "b"]).where(~spot.eqNullSafe(F.col("first"))).select("doc_id", "doc_key", "line").distinct()
    return again.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_repeated_lines(docs: DataFrame, edits=EDITS, dropped: str = "dropped_lines", keep_below: int = 0) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with the repeated lines taken out of ``text``, and ``dropped`` (their numbers, in order).

    Which lines: ``repeated_lines``. Repeated lines of fewer than ``keep_below`` characters are named in ``dropped``, but stay in the text, unless
    the document has longer repeated lines and nothing else but blank lines: then all its lines go. A column named ``dropped`` is replaced. NULL texts stay NULL, texts without repeated lines stay as they are.
    """
    docs = docs.drop(dropped)
    lines = cut_lineage(repeated_lines(docs, edits))
    keyed_schema = StructType([*docs.schema.fields, StructField("_key", LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(lines.select("doc_key")))

    def keyed(maybe: bool):
        """Documents that may have repeated lines, or the others, with the key of their text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches):
                keys = np.array(document_keys(texts), np.int64)
                kept = pa.array(passes(shared.value, keys) == maybe)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys)], keyed_schema.names).filter(kept)

        return docs.mapInArrow(run, keyed_schema)

    none = F.array().cast("array<int>")
    mark, untouched = keyed(True), keyed(False).drop("_key").withColumn(dropped, none)
    marks = lines.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_other"), F.col("lines").alias("_lines"))
    met = mark.join(marks, (F.col("_key") == F.col("_other")) & mark["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("_lines", i))
    if keep_below:
        lost = F.exists(F.transform(parts, lambda x, i: F.array_contains("_lines", i) & (F.length(x) >= keep_below)), lambda x: x)
        some = F.filter(parts, lambda x, i: ~F.array_contains("_lines", i) | (F.length(x) < keep_below))
        kept = F.when(lost & F.forall(kept, lambda x: F.trim(x, F.lit(BLANKS)) == ""), F.array().cast("array<string>")).otherwise(some)
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else mark[c] for c in docs.columns]
    return untouched.unionByName(met.select(*columns, F.coalesce("_lines", none).alias(dropped)))


def dedup_lines(docs: DataFrame, edits=EDITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines and the remaining text of every document."""
    done = drop_repeated_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines")), edits)
    return done.select("doc_id", "n_lines", F.size("dropped_lines").alias("n_dropped"), "dropped_lines", "text")
