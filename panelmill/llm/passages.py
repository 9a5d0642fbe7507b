"""Removal of byte strings that occur earlier in the corpus: common prefixes by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import BASE, mix, slices
from panelmill.llm.filters import KeyFilter, key_filter
from panelmill.session import cut_lineage

#: Length of the byte strings whose smallest hash is a window's anchor.
GRAM = 24
#: Texts are hashed in stretches of about so many bytes, which fit in a core's cache.
STRETCH = 1 << 18
#: Bytes of texts whose equal contexts are merged before the shuffle, and of contexts that are sorted at once.
BLOCK_BYTES, SORT_BYTES = 16_000_000, 1 << 20
#: A run of windows with one anchor is cut at so many windows.
RUN = 4096
#: Anchors of so many contexts are replaced by the windows' own hashes.
HOT = 2048


def _gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every ``size`` bytes, by doubling."""
    hashes, width = raw.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    rest = size
    while True:
        if rest & 1:
            if out is None:
                out, done = hashes, width
            else:
                n = len(raw) - done - width + 1
                out = out[:n] * np.uint64(pow(BASE, width, 2**64)) + hashes[done : done + n]
                done += width
        rest >>= 1
        if not rest:
            return mix(out)
        hashes = hashes[:-width] * np.uint64(pow(BASE, width, 2**64)) + hashes[width:]
        width *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` values in a row."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def _runs(texts: list[bytes], least: int, hot: KeyFilter | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, text, first window, windows, content hash, keyed anew, may repeat within) of maximal runs of windows that share their key, for stretches of texts.

    A window is ``least`` bytes; its anchor is the smallest hash of its ``GRAM``-byte strings, so equal windows have equal anchors wherever they stand.
    Windows whose anchor is in ``hot`` are keyed by their own hash instead. Two windows of a run can only be equal if their anchors stand at two places.
    """
    start = 0
    lengths = np.array([len(t) for t in texts], np.int64)
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + lengths[end] <= STRETCH):
            size += int(lengths[end])
            end += 1
        # The byte 0xff, which no UTF-8 text holds, stands between texts.
        raw = np.frombuffer(b"\xff".join(texts[start:end]), np.uint8)
        windows = np.maximum(lengths[start:end] - least + 1, 0)
        if windows.any():
            first = np.cumsum(lengths[start:end] + 1) - lengths[start:end] - 1
            owner = np.repeat(np.arange(end - start), windows)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
            grams = _gram_hashes(raw, GRAM)
            # The first place of the smallest upper half is in the lower half.
            anchor = _least(grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64), least - GRAM + 1)[at] & np.uint64(0xFFFFFFFF)
            key = grams[anchor.view(np.int64)]
            own = _gram_hashes(raw, least)[at]
            anew = np.zeros(len(at), bool)
            if hot is not None:
                anew = hot.passes(key.view(np.int64))
                key = np.where(anew, own, key)
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(at)))
            content = own[heads] * np.uint64(3) + own[heads + sizes - 1]
            within = np.where(anew[heads], sizes > 1, anchor[heads] != anchor[heads + sizes - 1])
            yield key[heads].view(np.int64), owner[heads] + start, at[heads] - first[owner[heads]], sizes, content, anew[heads], within
        start = end


def _count(least: int, hot=None):
    """Keys of a task's runs: ``n`` runs, ``kinds`` contexts. A run that may repeat within counts as two. With ``hot`` only the keys made anew."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows():
            key, n, content = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((content, key))
            key, n, content = key[order], n[order], content[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            kind = new.copy()
            kind[1:] |= content[1:] != content[:-1]
            heads = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.array(np.add.reduceat(n, heads)), pa.array(np.add.reduceat(kind.astype(np.int64), heads))], ["key", "n", "kinds"])

        for _, texts in slices(batches):
            for key, _, _, _, content, anew, within in _runs([t.encode("utf-8", "surrogatepass") for t in texts], least, hot.value if hot else None):
                n = 1 + within.astype(np.int64)
                held.append((key[anew], n[anew], content[anew]) if hot else (key, n, content))
                size += len(held[-1][0])
            if size > 1_000_000:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return count


CONTEXTS = "key long, doc_id long, h long, first long, windows long, context binary, within boolean"


def _gather(least: int, hot, repeated):
    """Contexts of the runs that may repeat, once per block and content. A run whose context stood earlier in the block is a finding already (``context`` NULL)."""

    def block_rows(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        # Rows of equal id and text are one document here.
        block.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        block = [x for x, before in zip(block, [None, *block], strict=False) if before is None or x[:2] != before[:2]]
        texts = [t for _, _, t in block]
        seen: set[bytes] = set()
        out: list[list] = [[] for _ in range(7)]
        size = 0
        last = (None, None)
        for key, text, first, windows, _, _, within in _runs(texts, least, hot.value if hot else None):
            may = np.flatnonzero(repeated.value.passes(key))
            for k, t, at, n, inner in zip(key[may].tolist(), text[may].tolist(), first[may].tolist(), windows[may].tolist(), within[may].tolist(), strict=True):
                own, doc_id, h = texts[t], block[t][0], block[t][1]
                for start in range(at, at + n, RUN):
                    count = min(RUN, at + n - start)
                    context = own[start : start + count + least - 1]
                    if context in seen:
                        if last == (t, start):
                            out[4][-1] += count
                        else:
                            for column, x in zip(out, (h, doc_id, h, start, count, None, False), strict=True):
                                column.append(x)
                        last = (t, start + count)
                        continue
                    seen.add(context)
                    last = (None, None)
                    size += len(context)
                    for column, x in zip(out, (k, doc_id, h, start, count, context, inner), strict=True):
                        column.append(x)
            if size > 4_000_000:
                yield _batch(out)
                out, size, last = [[] for _ in range(7)], 0, (None, None)
        if out[0]:
            yield _batch(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for part, texts in slices(batches):
            for doc_id, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= least:
                    block.append((doc_id, h, data))
                    size += len(data)
            if size >= BLOCK_BYTES:
                yield from block_rows(block)
                block, size = [], 0
        yield from block_rows(block)

    return gather


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CONTEXTS.split(", ")])


def _sorted_suffixes(text: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``least`` symbols or more, common prefixes below 8, and where groups of 8 equal symbols start.

    ``text``: bytes plus 1, and 0 behind every context; ``left``: symbols up to that 0. Such ends are all different, in order of place. Prefixes of
    8 symbols are compared as numbers, then doubled; only suffixes that are still equal are sorted again.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    short = left < 8
    word[short] &= ~np.uint64(0) << ((8 - left[short]) * 8).astype(np.uint64) if short.any() else np.uint64(0)
    word[left == 0] = 0
    order = np.argsort(word, kind="stable")
    key = word[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | short[order[1:]] | short[order[:-1]] & (key[1:] == key[:-1])
    prefix = np.zeros(n, np.uint8)
    if n > 1:
        differ = key[1:] ^ key[:-1]
        equal = np.zeros(n - 1, np.uint8)
        for k in range(1, 8):
            equal += differ >> np.uint64(64 - 8 * k) == 0
        # Equal numbers with an end inside have the symbols before it in common.
        prefix[1:] = np.where(differ == 0, np.minimum(left[order[1:]], 8), equal)
    starts = new.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 8
    while width < least:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        own = order[at]
        both = rank[own] << 32 | rank[own + width]
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[at] = own
        fresh = np.ones(len(at), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[at] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, at, 0))
        width *= 2
    return order, prefix, starts


def common_prefixes(text: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the length of the common prefix of each with the one before it, where it is below ``least`` (else 255).

    Breadth-first backward extension on the Burrows-Wheeler transform: the intervals of strings of length m are extended by every symbol that precedes
    them; if the boundary behind an extended interval has no value yet, its value is m and the interval goes on. So values come in
    increasing order, and the search stops at ``least``. The values below 8 come from the prefixes compared as numbers.
    """
    n = len(text)
    order, prefix, starts = _sorted_suffixes(text, left, least)
    bwt = text[order - 1]
    step = np.empty(n, np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(n)
    run = np.cumsum(np.diff(bwt, prepend=bwt[:1]) != 0)
    value = np.full(n + 1, 255, np.uint8)
    value[:n][starts] = prefix[starts]
    value[0] = value[n] = 0
    low = np.flatnonzero(starts)
    high = np.append(low[1:], n) - 1
    going = value[high + 1] == 7
    going[-1] = False
    low, high = low[going], high[going]
    for length in range(8, least):
        if not len(low):
            break
        even = run[low] == run[high]
        real = even & (bwt[low] != 0)
        lows, highs = [step[low[real]]], [step[high[real]]]
        low, high = low[~even], high[~even]
        if len(low):
            sizes = high - low + 1
            inside = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            child = np.repeat(np.arange(len(low)), sizes) << 8 | bwt[inside]
            by = np.argsort(child, kind="stable")
            child, inside = child[by], inside[by]
            heads = np.flatnonzero(np.diff(child, prepend=-1))
            tails = np.append(heads[1:], len(child)) - 1
            real = child[heads] & 255 != 0
            lows.append(step[inside[heads[real]]])
            highs.append(step[inside[tails[real]]])
        low, high = np.concatenate(lows), np.concatenate(highs)
        open_ = value[high + 1] == 255
        low, high = low[open_], high[open_]
        value[high + 1] = length
    return order, value[:n]


FOUND = "doc_id long, h long, first long, windows long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole keys, about ``SORT_BYTES`` at once."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= SORT_BYTES:
            key = batch.column(0).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change):
                cut = int(change[-1]) + 1
                held[-1] = batch.slice(0, cut)
                yield pa.Table.from_batches(held)
                held = [batch.slice(cut)]
                size = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


def _find(least: int):
    """Windows that stand earlier, among the contexts of the keys that reach the task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            done = rows.column("context").is_null()
            yield from rows.filter(done).select(["doc_id", "h", "first", "windows"]).to_batches()
            rows = rows.filter(rows.column("context").is_valid())
            _, where, count = np.unique(rows.column("key").to_numpy(), return_inverse=True, return_counts=True)
            rows = rows.filter(pa.array((count[where] > 1) | rows.column("within").to_numpy())) if rows.num_rows else rows
            if rows.num_rows:
                yield from _earlier(rows.combine_chunks(), least)

    return find


def _earlier(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    column = lambda name: rows.column(name).combine_chunks()
    known = column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    doc, h = column("doc_id").fill_null(0).to_numpy(), column("h").to_numpy()
    first, windows = column("first").to_numpy(), column("windows").to_numpy()
    order = np.lexsort((first, h, doc, known))
    other = np.ones(len(order), bool)
    other[1:] = (known[order][1:] != known[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(other) << 40
    place += first
    coded = column("context").dictionary_encode()
    context = coded.indices.to_numpy()
    by_place = np.argsort(place, kind="stable")
    head = by_place[np.unique(context[by_place], return_index=True)[1]]
    # A row whose context stands earlier is found as a whole; rows of one place are the same.
    later = place > place[head[context]]
    found = [(np.flatnonzero(later), first[later], windows[later])]
    strings = coded.dictionary
    bounds = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(len(owner)) - (bounds[:-1] + np.arange(len(size)))[owner]
    left = size[owner] - offset
    text = np.zeros(len(owner), np.uint8)
    text[left > 0] = raw + 1
    suffix, prefix = common_prefixes(text, left, least)
    equal = prefix == 255
    member = equal | np.append(equal[1:], False)
    at = suffix[member]
    starts = np.flatnonzero(~equal[member])
    if len(starts):
        value = place[head[owner[at]]] + offset[at]
        earliest = np.repeat(np.minimum.reduceat(value, starts), np.diff(np.append(starts, len(at))))
        seen = np.zeros(len(text) + 1, bool)
        seen[at[value > earliest]] = True
        edge = np.flatnonzero(np.diff(seen.view(np.int8), prepend=0))
        begin, end = edge[0::2], edge[1::2]
        row = head[owner[begin]]
        found.append((row, first[row] + offset[begin], end - begin))
    row, begin, count = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(row):
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([column("doc_id").take(row), column("h").take(row), pa.array(begin, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "h", "first", "windows"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def repeated_windows(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, h (hash of the text), first, windows: runs of start positions whose ``least`` bytes also start earlier. A run may come twice.

    Earlier means in a document of smaller doc_id (NULL first; of equal ids: of smaller hash) or before it in the same document. Equal windows have equal keys, so
    only keys that occur twice matter: a filter sized from their count tells the tasks which. Contexts of these runs are merged
    within blocks of documents and meet by key, where the transform compares them. Keys of many different contexts (a common short line) are replaced by
    hashes of whole windows, so a key has at most ``HOT`` contexts or one context per block.
    """
    if least <= GRAM:
        raise ValueError(f"least must exceed {GRAM} bytes")
    spark, texts = docs.sparkSession, _keyed(docs)
    counts = "key long, n long, kinds long"

    def counted(hot=None) -> DataFrame:
        return texts.select("text").mapInArrow(_count(least, hot), counts).groupBy("key").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).where("n > 1")

    keys = cut_lineage(counted())
    hot, common = None, keys.where(F.col("kinds") >= HOT).select("key")
    if not common.isEmpty():
        hot = spark.sparkContext.broadcast(key_filter(common))
        keys = keys.unionByName(cut_lineage(counted(hot)))
    repeated = spark.sparkContext.broadcast(key_filter(keys.select("key")))
    contexts = texts.mapInArrow(_gather(least, hot, repeated), CONTEXTS)
    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_find(least), FOUND)


def removed_spans(runs: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that the windows of the runs (first, windows) cover."""
    out: list[tuple[int, int]] = []
    for first, windows in sorted(runs):
        end = first + windows + least - 1
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def drop_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, in order), kept (the other bytes) of every row of ``docs`` (doc_id, text).

    Removed is every byte that a ``least``-byte string covers which also starts earlier in the corpus, judged on the input. NULL texts are empty. Of rows of equal id and text, one counts
    as the first and the others lose everything if they have ``least`` bytes. Other columns are ignored; an empty table gives no rows.
    A kept text may begin or end within a character.
    """
    runs = repeated_windows(docs, least).groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "windows")).alias("runs"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h"))
    texts = _keyed(docs).withColumn("nth", nth)
    found = runs.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), "runs")
    joined = texts.join(found, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left").select("doc_id", "text", "nth", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(iter([batch])):
                sizes, spans, kept = [], [], []
                for text, nth, runs in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    own = removed_spans([(r["first"], r["windows"]) for r in runs or ()], least)
                    if nth > 1 and len(data) >= least:
                        own = [(0, len(data))]
                    at, rest = 0, []
                    for start, end in own:
                        rest.append(data[at:start])
                        at = end
                    rest.append(data[at:])
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(b"".join(rest))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, REMOVED)


def repeat_digests(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every document."""
    return drop_repeats(docs, least).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, i, i > 100 + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -200) AS fresh FROM later),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM runs),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
