"""Exact similarity joins in two steps: candidate blocks by shared keys, then every block joined where its texts meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import mix, sorted_groups
from panelmill.llm.graph import Forest, connected_components
from panelmill.session import cut_lineage, drop_stored

#: Bits of the filter that keeps most texts out of a shuffle; the driver holds two MB of it, whatever the input.
FILTER_BITS = 1 << 24


def _bits(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bit table of a long column. It may let other ids pass, never hold one back; beyond some millions of ids it lets most pass."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column(0).drop_null().to_numpy())
            words, where = np.unique(bits >> 6, return_inverse=True)
            masks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(masks, where, np.uint64(1) << (bits & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks.view(np.int64))], ["word", "mask"])

    got = ids.mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = _bits(values)
    return (table[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) != 0


def filtered(rows: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """Rows whose id passes the filter; NULL ids do not."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            yield batch.filter(pa.array(passes(shared.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(keep, rows.schema)


#: Joins texts: (nodes, texts, side, component of each or the node itself) -> edges. A pair needs a text of side 1.
Local = Callable[[list[int], list[str], np.ndarray, list[int]], list[tuple[int, int]]]


def _joined(rows: DataFrame, keys: list[str], local: Local) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            nodes, texts = group.column("node").to_pylist(), group.column("text").to_pylist()
            if len(nodes) > 1:
                forest = Forest()
                for a, b in local(nodes, texts, group.column("side").to_numpy(), group.column("component").to_pylist()):
                    forest.join(a, b)
                # Stars need no further round of the components.
                edges = [(v, forest.root(v)) for v in forest.parent if forest.root(v) != v]
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    placed = rows.select(*keys, "node", "text", "side", "component")
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


def link_blocks(members: DataFrame, local: Local, part_rows: int = 2000, part_chars: int = 8_000_000) -> DataFrame:
    """Edges (a, b), stars in each task, whose components are those of all links inside the blocks. ``members``: node, block, text and, if known, keys.

    A block of at most ``part_rows`` rows and ``part_chars`` characters is joined in one task. A larger one is split into parts: each part
    is joined together with the block's first text, which settles a tight group in linear work; what is then outside the block's largest
    component meets all parts, pair by pair in separate tasks, or, where that sends fewer rows, what shares one of its ``keys`` (an array; linked
    texts share one): the parts of a chain of weak keys would grow with the square of its length. So no task holds a block of any size, and no
    pair that could join two components is left out. The texts are stored for this and go with it; the edges are stored.
    """
    members = cut_lineage(members)
    sizes = members.groupBy("block").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"), F.min("node").alias("first"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("rows") / part_rows), F.ceil(F.col("chars") / part_chars)).cast("int"))
    large = cut_lineage(sizes.where("parts > 1"))
    whole = members.join(large, "block", "left_anti").select("*", F.lit(1).alias("side"), F.col("node").alias("component"))
    edges = _joined(whole, ["block"], local)
    if large.isEmpty():
        edges = cut_lineage(edges)
        drop_stored(members, large)
        return edges
    split = members.join(large.select("block", "parts", "first"), "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    first = split.where("node = first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    alone = split.where("node <> first").unionByName(first).select("*", F.lit(1).alias("side"), F.col("node").alias("component"))
    near = cut_lineage(_joined(alone, ["block", "part"], local))
    split = split.join(connected_components(near), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = split.groupBy("block", "component").agg(F.count("*").alias("n"))
    largest = groups.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    split = split.join(largest, "block")
    met = None
    if "keys" in members.columns:
        groups, by_keys = _key_groups(split, part_rows, part_chars)
        shared = split.join(by_keys, "block").select("block", "node", "text", F.explode("keys").alias("key")).join(groups, ["block", "key"])
        met = link_blocks(shared.select("node", F.col("group").alias("block"), "text"), local, part_rows, part_chars)
        split = split.join(by_keys, "block", "left_anti")
    outside = split.where("component <> largest")
    rows, chars = F.ceil(F.count("*") / part_rows), F.ceil(F.sum(F.length("text")) / part_chars)
    counts = outside.groupBy("block").agg(F.greatest(rows, chars).cast("int").alias("outer_parts"))
    outside = outside.join(counts, "block").select(
        "block", "node", "text", "component", F.lit(1).alias("side"), F.pmod(F.xxhash64("node"), F.col("outer_parts")).cast("int").alias("outer"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    every = split.join(counts, "block").select(
        "block", "node", "text", "component", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("outer_parts") - 1)).alias("outer"), "part"
    )
    apart = _joined(outside.unionByName(every), ["block", "outer", "part"], local)
    edges = cut_lineage(edges.union(near).union(apart) if met is None else edges.union(near).union(apart).union(met))
    drop_stored(members, large, near, *([] if met is None else [met, groups, by_keys]))
    return edges


def _key_groups(split: DataFrame, part_rows: int, part_chars: int) -> tuple[DataFrame, DataFrame]:
    """(block, key, group) of the groups of rows of a block that share a key and of which one is outside its largest component, equal groups once; and the blocks whose
    groups have fewer rows than the parts of the block would send."""
    outer = F.col("component") != F.col("largest")
    nodes = cut_lineage(split.select("block", "node", "keys", "parts", outer.alias("outer"), F.length("text").alias("chars")))
    of_outer = lambda c: F.sum(F.when(F.col("outer"), c))
    outer_parts = F.greatest(F.ceil(of_outer(F.lit(1)) / part_rows), F.ceil(of_outer(F.col("chars")) / part_chars))
    sent = nodes.groupBy("block").agg((of_outer(F.lit(1)) * F.max("parts") + F.count("*") * outer_parts).alias("sent"))
    same = ["block", "rows", "least", "most", "one", "other"]
    by_key = nodes.select("block", "node", "outer", F.explode("keys").alias("key")).groupBy("block", "key").agg(
        F.count("*").alias("rows"), F.min("node").alias("least"), F.max("node").alias("most"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("one"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("other"), F.max("outer").alias("outer"),
    )
    groups = cut_lineage(by_key.where("outer and least < most").groupBy(*same).agg(F.min("key").alias("key")).select("block", "key", F.xxhash64(*same).alias("group"), "rows"))
    met = groups.groupBy("block").agg(F.sum("rows").alias("rows"))
    by_keys = cut_lineage(met.join(sent, "block").where("rows < sent").select("block"))
    drop_stored(nodes)
    return groups.select("block", "key", "group"), by_keys


def joined_already(forest: Forest, nodes: list[int], components: list[int]) -> None:
    """Start a forest from known components."""
    for node, component in zip(nodes, components, strict=True):
        if node != component:
            forest.join(node, component)
