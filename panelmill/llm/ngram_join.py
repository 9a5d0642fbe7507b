"""Jaccard join of word n-gram sets with prefix trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.blocks import filtered, id_filter, joined_already, link_blocks
from panelmill.llm.common import BLANK_SEPARATED, Words, mix, slices
from panelmill.llm.graph import Forest, connected_components
from panelmill.session import cut_lineage, drop_stored

#: One n-gram in four takes part in the frequency count; the others stand behind them in the global order.
COUNTED = 4
#: n-grams in more than this share of a task's texts are not counted exactly, and at most so many.
FREQUENT, MOST_FREQUENT = 0.01, 10_000
#: Sets of blocks of more nodes meet with the keys that joined them: a block of many parts may be a chain, which these keys cut.
CHAINED = 2000


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the ``n``-word shingles; a text of fewer words has its whole sequence as one, without words none."""
    words = Words(texts, BLANK_SEPARATED)
    h, out = words.hashes, []
    rolled = h.copy()
    for k in range(1, min(n, len(h))):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k]) + h[k:]
    rolled = mix(rolled) >> np.uint64(1)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            value = h[a : a + 1]
            for k in range(a + 1, b):
                value = mix(value) + h[k : k + 1]
            out.append(mix(value + np.uint64(b - a)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(shingles: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set: sums of two independent mixtures of its members."""
    return int(np.sum(mix(shingles)) >> np.uint64(1)), int(np.sum(mix(shingles * np.uint64(5) + np.uint64(3))) >> np.uint64(1))


def prefix_length(n: int, percent: int) -> int:
    """Two sets that reach the threshold share one of the first so many members of either, in any global order."""
    return n - -(-percent * n // 100) + 1


def band_width(percent: int) -> float:
    """Width on the scale of log sizes: sets at the threshold lie in the same or in adjacent bands (a little more, for rounding)."""
    return math.log(100 / percent) * (1 + 1e-9)


SETS = "doc_id long, text_key long, n long, node long, check long, counted array<long>, rest array<long>"


def _sets(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SETS.split(", ")]
        for part, texts in slices(batches):
            rows = []
            for s in shingle_sets(texts, n):
                node, check = set_ids(s) if len(s) else (None, None)
                counted = s[s % np.uint64(COUNTED) == 0]
                short = max(0, prefix_length(len(s), percent) - len(counted)) if len(s) else 0
                rest = s[s % np.uint64(COUNTED) != 0][:short]
                rows.append((len(s), node, check, counted.view(np.int64), rest.view(np.int64)))
            ns, nodes, checks, counted, rest = zip(*rows, strict=True)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(list(counted), lists), pa.array(list(rest), lists)],
                names,
            )

    return run


def _frequent_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams in more than a hundredth of a batch's texts, and at least 20."""
    for batch in batches:
        values, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        often = counts >= max(20, FREQUENT * batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(counts[often])], ["h", "n"])


def _postings(frequent: np.ndarray, width: float):
    """(n-gram, node, size band) of each distinct set of a task, without the frequent n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            fresh = [i for i, v in enumerate(nodes) if v not in seen and not seen.add(v)]
            part = batch.take(pa.array(fresh, pa.int64()))
            lists = part.column(2)
            sizes = lists.value_lengths().to_numpy()
            owner = np.repeat(part.column(0).to_numpy(), sizes)
            band = np.repeat(np.floor(np.log(part.column(1).to_numpy()) / width).astype(np.int32), sizes)
            h = lists.flatten().to_numpy()
            keep = ~np.isin(h, frequent)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(owner[keep]), pa.array(band[keep])], ["h", "node", "band"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h, node, band) sorted by the first two: node, h and number of nodes of every h that a node of this or the next band holds, too.

    What two sets at the threshold share is always kept, with the same number for both, so they agree on its order; other members
    of a set may stand anywhere before it.
    """
    h0, v0, s0 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def counted(h: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
        h, v, s = h[fresh], v[fresh], s[fresh]
        _, where, n = np.unique(h, return_inverse=True, return_counts=True)
        df = n[where] if len(h) else n
        place = where.astype(np.int64) * 65_536 + s + 1
        places, own, count = np.unique(place, return_inverse=True, return_counts=True)
        often = count[own] > 1 if len(h) else np.zeros(0, bool)
        for step in (-1, 1):
            at = np.minimum(np.searchsorted(places, place + step), max(0, len(places) - 1))
            often |= places[at] == place + step if len(h) else often
        return pa.RecordBatch.from_arrays([pa.array(v[often]), pa.array(h[often]), pa.array(df[often])], ["node", "h", "df"])

    for batch in batches:
        h, v, s = (np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate((h0, v0, s0)))
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        yield counted(h[:cut], v[:cut], s[:cut])
        h0, v0, s0 = h[cut:], v[cut:], s[cut:]
    yield counted(h0, v0, s0)


class PrefixTree:
    """Compressed prefix tree of sorted paths: nodes in arrays, children and the paths that end at a node as ranges."""

    def __init__(self, paths: list[np.ndarray]):
        start, end, path, parent = [0], [0], [0], [-1]
        ends_at: list[int] = []
        stack = [0]
        for i, own in enumerate(paths):
            shared = 0
            if i:
                k = min(len(paths[i - 1]), len(own))
                differ = np.flatnonzero(paths[i - 1][:k] != own[:k])
                shared = int(differ[0]) if len(differ) else k
            while start[stack[-1]] >= shared and stack[-1]:
                stack.pop()
            top = stack[-1]
            if end[top] > shared:
                # The path leaves within this node: its upper part becomes a node of its own.
                upper = len(start)
                start.append(start[top])
                end.append(shared)
                path.append(path[top])
                parent.append(parent[top])
                start[top], parent[top] = shared, upper
                stack[-1] = upper
            if len(own) > shared:
                start.append(shared)
                end.append(len(own))
                path.append(i)
                parent.append(stack[-1])
                stack.append(len(start) - 1)
                ends_at.append(len(start) - 1)
            else:
                ends_at.append(ends_at[-1])
        self.flat = np.concatenate(paths)
        sizes = np.array([len(x) for x in paths])
        self.base = np.cumsum(sizes) - sizes
        self.size = sizes
        self.end = np.array(end)
        self.first = self.base[np.array(path)] + np.array(start)
        self.length = self.end - np.array(start)
        self.children, self.child_at, self.child_count = _ranges(np.array(parent), len(start))
        self.done, self.done_at, self.done_count = _ranges(np.array(ends_at), len(start))
        # Largest number of a path below each node: children have larger ends, so deepest nodes come first.
        self.largest = np.full(len(start), -1)
        np.maximum.at(self.largest, np.array(ends_at), np.arange(len(paths)))
        for node in np.argsort(-self.end, kind="stable").tolist():
            if parent[node] >= 0:
                self.largest[parent[node]] = max(self.largest[parent[node]], self.largest[node])

    def matches(self, x: np.ndarray, mark: np.ndarray, after: int, percent: int) -> np.ndarray:
        """Numbers above ``after`` of the paths at the Jaccard threshold with ``x``; ``mark`` is 1 at its members.

        The tree is walked level by level. What a shared path overlaps is counted once, at its node; a subtree is left when the members that
        are already missing on either side rule out the threshold.
        """
        nx, found = len(x), []
        nodes = _take(self.children, self.child_at[[0]], self.child_count[[0]])
        overlap = np.zeros(len(nodes), np.int64)
        while len(nodes):
            keep = self.largest[nodes] > after
            nodes, overlap = nodes[keep], overlap[keep]
            if not len(nodes):
                break
            first, length = self.first[nodes], self.length[nodes]
            heads = np.cumsum(length) - length
            overlap = overlap + np.add.reduceat(mark[_take(self.flat, first, length)], heads)
            lost = np.searchsorted(x, self.flat[first + length - 1], side="right") - overlap
            alive = 100 * (nx - lost) >= percent * (nx + self.end[nodes] - overlap)
            nodes, overlap = nodes[alive], overlap[alive]
            paths = _take(self.done, self.done_at[nodes], self.done_count[nodes])
            total = np.repeat(overlap, self.done_count[nodes])
            found.append(paths[(paths > after) & (100 * total >= percent * (nx + self.size[paths] - total))])
            overlap = np.repeat(overlap, self.child_count[nodes])
            nodes = _take(self.children, self.child_at[nodes], self.child_count[nodes])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ranges(owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members by owner, and where each owner's range starts and how long it is; negative owners have none."""
    members = np.argsort(owner, kind="stable")
    members = members[owner[members] >= 0]
    sizes = np.bincount(owner[owner >= 0], minlength=count)
    return members, np.cumsum(sizes) - sizes, sizes


def _take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length]."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def tree_join(sets: list[np.ndarray], linked, percent: int) -> None:
    """Find all pairs of sets at the Jaccard threshold and report them by ``linked(i, js)``.

    The sets, their members ordered from frequent to rare, are the paths of a prefix tree, which each of them probes for the paths behind it.
    """
    _, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum([len(s) for s in sets])
    paths = [np.sort(order[ranks[e - len(s) : e]]) for s, e in zip(sets, ends, strict=True)]
    by_path = np.array(sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes()))
    paths = [paths[i] for i in by_path]
    tree = PrefixTree(paths)
    mark = np.zeros(len(counts), np.int64)
    for a, x in enumerate(paths):
        mark[x] = 1
        linked(int(by_path[a]), by_path[tree.matches(x, mark, a, percent)].tolist())
        mark[x] = 0


def _local(n: int, percent: int):
    def local(nodes: list[int], texts: list[str], side: np.ndarray, components: list[int]) -> list[tuple[int, int]]:
        keep, sets, first = [], [], {}
        for at in range(0, len(texts), 500):
            for i, s in enumerate(shingle_sets(texts[at : at + 500], n), at):
                # Rows of equal id but other text come along with the join by id; a set is entered once per side.
                if len(s) and set_ids(s)[0] == nodes[i] and (nodes[i], side[i]) not in first:
                    first[nodes[i], side[i]] = i
                    keep.append(i)
                    sets.append(s)
        if len(keep) < 2:
            return []
        forest, edges = Forest(), []
        ids = [nodes[i] for i in keep]
        joined_already(forest, ids, [components[i] for i in keep])

        def link(i: int, others: list[int]) -> None:
            for j in others:
                if (side[keep[i]] or side[keep[j]]) and forest.join(ids[i], ids[j]):
                    edges.append((ids[i], ids[j]))

        tree_join(sets, link, percent)
        return edges

    return local


def document_classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, class_a, class_b of every row of ``docs`` (doc_id, text; other columns are ignored). Rows of one class share both.

    Linked: |intersection| * 100 >= ``percent`` * |union| of the sets of ``n``-word shingles of the whole texts. NULL texts and texts without words
    have no set, no class, and link with nothing. Rows whose doc_id is NULL join the class of an equal set, but do not link others. Equal sets are one node of the graph, so copies cost nothing more.

    Candidates: two sets at the threshold share a member of their prefixes in a global order, here by document frequency for the counted quarter
    of n-grams (very frequent ones, found by a bounded count, behind them), then the rest by hash. Only n-grams that sets of comparable size share travel on.
    Sets that share prefix members, directly or in chains, form a block; its texts meet once and are joined by ``tree_join``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    sets = cut_lineage(rows.mapInArrow(_sets(n, percent), SETS))
    live = sets.where("node is not null")
    common = live.select("counted").mapInArrow(_frequent_here, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    frequent = np.array(sorted(r["h"] for r in common.select("h").collect()), np.int64)
    postings = live.select("node", "n", "counted").mapInArrow(_postings(frequent, band_width(percent)), "h long, node long, band int")
    shared = postings.repartition("h").sortWithinPartitions("h", "node").mapInArrow(_shared, "node long, h long, df long")
    shared = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths()
            often = [x[np.isin(x, frequent)].tolist() for x in (np.array(v, np.int64) for v in batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), size.cast(pa.int64()), pa.array(often, pa.list_(pa.int64())), batch.column(3)], ["node", "n", "size", "often", "rest"]
            )

    shapes = live.select("node", "n", "counted", "rest").mapInArrow(shape, "node long, n long, size long, often array<long>, rest array<long>")
    shapes = shapes.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "size", "often", "rest")])
    ordered = shapes.join(shared, "node", "left").withColumn("shared", F.coalesce(F.col("shared.h"), F.array().cast("array<long>")))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    needed = (length - (F.col("size") - F.size("shared") - F.size("often"))).cast("int")
    prefix = F.slice(F.concat("shared", "often", "rest"), F.lit(1), F.greatest(needed, F.lit(0)))
    band = F.floor(F.log("n") / band_width(percent)).cast("int")
    tokens = ordered.select("node", band.alias("band"), F.explode(prefix).alias("token"))
    # In its own band and the next: sets of adjacent bands meet in the larger one.
    tokens = cut_lineage(tokens.select("node", "token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")))
    leads = tokens.groupBy("token", "band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last")
    blocks = connected_components(tokens.join(leads, ["token", "band"]).select("lead", "node").where("lead <> node"))
    blocks = cut_lineage(blocks.withColumnRenamed("component", "block"))
    one = live.where("doc_id is not null").groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"))
    chained = blocks.join(blocks.groupBy("block").agg(F.count("*").alias("nodes")).where(F.col("nodes") > CHAINED), "block", "left_semi").select("node")
    keys = tokens.join(leads, ["token", "band"]).join(chained, "node", "left_semi").groupBy("node").agg(F.collect_list(F.xxhash64("token", "band")).alias("keys"))  # a prefix, twice
    wanted = cut_lineage(one.join(blocks, "node").join(keys, "node", "left").select("doc_id", "node", "block", "keys"))
    # The n-grams are not kept beside the texts that meet.
    named = cut_lineage(sets.select("doc_id", "text_key", "n", "node", "check"))
    drop_stored(sets, tokens, blocks)
    texts = filtered(rows.drop("text_key"), "doc_id", id_filter(wanted.select("doc_id")))
    members = texts.join(wanted, "doc_id").select("node", "block", F.coalesce("text", F.lit("")).alias("text"), "keys")
    found = connected_components(link_blocks(members, _local(n, percent)))
    named = named.join(found, "node", "left")
    check = F.when(F.col("component").isNull(), F.col("check")).otherwise(0)
    return named.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("class_a"), check.alias("class_b"))


def link_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the class) of every row of ``docs``, by ``document_classes``. A NULL doc_id stays alone in its id (NULL)."""
    named = document_classes(docs, n, percent)
    first = named.where("class_a is not null").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("component_id"))
    out = named.join(first, ["class_a", "class_b"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the rows of ``docs`` that are the first of their class by (doc_id, text_key), one row each.

    Decided by row, not by id: rows of one id with different texts are different documents. Rows without an id and rows without words are copies of nothing and all stay.
    """
    named = document_classes(docs, n, percent).where("class_a is not null and doc_id is not null")
    spot = F.struct("doc_id", "text_key")
    firsts = named.groupBy("class_a", "class_b").agg(F.min(spot).alias("first")).select(F.col("first.doc_id").alias("_first_id"), F.col("first.text_key").alias("_first_key"))
    # The bytes between words are those of ``BLANK_SEPARATED``.
    alone = F.col("doc_id").isNull() | ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    keyed = docs.where(~alone).withColumn("_own_key", F.xxhash64("text"))
    met = keyed.join(firsts, (F.col("doc_id").cast("long") == F.col("_first_id")) & (F.col("_own_key") == F.col("_first_key")))
    nth = F.row_number().over(Window.partitionBy("_first_id", "_first_key").orderBy("_own_key"))
    return docs.where(alone).unionByName(met.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns))
