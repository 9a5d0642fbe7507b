"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import sorted_groups
from panelmill.llm.graph import Forest, connected_components
from panelmill.session import cut_lineage


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` hash tables of ``functions`` concatenated hashes; each function looks at its ``probes`` nearest vertices."""

    tables: int = 6
    functions: int = 2
    probes: int = 2
    rounds: int = 3
    seed: int = 17

    def rotate(self, x: np.ndarray, which: int) -> np.ndarray:
        """Pseudo-random rotation: ``rounds`` of random signs and a fast Hadamard transform of the padded vectors."""
        n = 1 << max(1, (x.shape[1] - 1).bit_length())
        y = np.zeros((len(x), n))
        y[:, : x.shape[1]] = x
        signs = np.random.default_rng([self.seed, which]).choice([-1.0, 1.0], (self.rounds, n))
        for s in signs:
            y = y * s
            h = 1
            while h < n:
                y = y.reshape(len(x), n // (2 * h), 2, h)
                y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2)
                h *= 2
            y = y.reshape(len(x), n) / np.sqrt(n)
        return y

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers, shape (vectors, tables, probes ** functions); the first is the vector's own bucket."""
        out = []
        for t in range(self.tables):
            combined = np.zeros((len(x), 1), np.int64)
            for f in range(self.functions):
                y = self.rotate(x, t * self.functions + f)
                top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : self.probes]
                vertex = 2 * top + (np.take_along_axis(y, top, 1) < 0)
                combined = (combined[:, :, None] * (2 * y.shape[1]) + vertex[:, None, :]).reshape(len(x), -1)
            out.append(combined)
        return np.stack(out, 1)


def _unit(column: pa.ListArray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    # Scaling by the largest component first keeps squares of extreme values finite.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dealt(scheme: CrossPolytope):
    """One row per vector and bucket it belongs to or probes, with all its buckets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                b = scheme.buckets(_unit(part.column(2)))
                keys = [r.tobytes() for r in b.astype("<u4" if b.max() < 2**32 else "<i8")]
                n, tables, probes = b.shape
                index = pa.array(np.repeat(np.arange(n), tables * probes))
                table = np.tile(np.repeat(np.arange(tables), probes), n)
                flat = b.ravel()
                place = (flat * tables + table) * 65_536 + dim
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), part.column(0).take(index), part.column(1).take(index), part.column(2).take(index), pa.array(keys, pa.binary()).take(index),
                     pa.array(table.astype(np.int32)), pa.array(flat)],
                    ["place", "rep", "copies", "vector", "buckets", "bucket_table", "bucket"],
                )

    return deal


FOUND = "kind int, a long, b long"


def _verify(scheme: CrossPolytope, least: float):
    """Exact cosines within a bucket (or a pair of its parts); every pair is counted where it meets first.

    Gives (0, vector, linked rows) partial counts and (1, a, b) edges of a forest over the linked vectors.
    """
    probes = scheme.probes**scheme.functions

    def first_meeting(ka: np.ndarray, kb: np.ndarray, ia: np.ndarray, ib: np.ndarray, table: int, bucket: int) -> np.ndarray:
        """Which pairs meet in no earlier table, nor in the other's own bucket of this table if that comes first."""
        own_a, own_b = ka[ia][:, :, :1], kb[ib][:, :, :1]
        b_in_a = (kb[ib] == own_a).any(2)
        a_in_b = (ka[ia] == own_b).any(2)
        here = (own_a[:, table, 0] == bucket) & b_in_a[:, table] | (own_b[:, table, 0] == bucket) & a_in_b[:, table] & ~b_in_a[:, table]
        return here & ~(b_in_a | a_in_b)[:, :table].any(1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["place", "part_a", "part_b"]):
            table, bucket = group.column("bucket_table")[0].as_py(), group.column("bucket")[0].as_py()
            group = group.combine_chunks()
            rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            side = group.column("side").to_numpy()
            if len(rep) < 2:
                continue
            x = _unit(group.column("vector").combine_chunks())
            packed = b"".join(group.column("buckets").to_pylist())
            width = len(packed) // (len(rep) * scheme.tables * probes)
            keys = np.frombuffer(packed, f"<u{width}").reshape(len(rep), scheme.tables, probes)
            same = group.column("part_a")[0].as_py() == group.column("part_b")[0].as_py()
            left = np.arange(len(rep)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            links: dict[int, int] = {}
            forest = Forest()
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                i, j = np.nonzero(x[rows] @ x[right].T >= least)
                i, j = rows[i], right[j]
                # The smaller id is side a, so a pair is seen once and the same way in all buckets.
                keep = rep[i] < rep[j] if same else rep[i] != rep[j]
                i, j = i[keep], j[keep]
                swap = rep[i] > rep[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                keep = first_meeting(keys, keys, i, j, table, bucket) if len(i) else np.zeros(0, bool)
                i, j = i[keep], j[keep]
                for a, b in ((i, j), (j, i)):
                    for r, c in zip(*_sums(rep[a], copies[b]), strict=True):
                        links[r] = links.get(r, 0) + c
                for a, b in zip(rep[i].tolist(), rep[j].tolist(), strict=True):
                    forest.join(a, b)
            nodes = [v for v in forest.parent if forest.root(v) != v]
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(links) + [1] * len(nodes), pa.int32()), pa.array([*links, *nodes], pa.int64()),
                     pa.array([*links.values(), *[forest.root(v) for v in nodes]], pa.int64())],
                    ["kind", "a", "b"],
                )

    return verify


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    unique, where = np.unique(keys, return_inverse=True)
    return unique.tolist(), np.bincount(where, values, len(unique)).astype(int).tolist() if len(unique) else []


def link_vectors(vectors: DataFrame, least: float = 0.95, scheme: CrossPolytope | None = None, part_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Linked: cosine in double precision at least ``least``, among vectors of one length. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components link with nothing and keep themselves. Equal vectors are joined first and enter the search once, with their
    number. Buckets of more than ``part_rows`` rows are split into parts that meet pair by pair in separate tasks, so nothing is
    capped. Pairs are never sent: tasks send counts per vector and forests. Repeated ids are separate rows that share their
    component. The hash tables miss a link with small probability (the tests measure recall).
    """
    scheme = scheme or CrossPolytope()
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    v = F.col("embedding")
    sound = (
        v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull()
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    distinct = rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = cut_lineage(distinct)
    dealt = distinct.select("rep", "copies", "embedding").mapInArrow(
        _dealt(scheme), f"place long, rep long, copies long, vector {kind}, buckets binary, bucket_table int, bucket long"
    )
    # Only buckets beyond one part are listed; their number is at most rows / part_rows.
    large = dealt.groupBy("place").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).where("parts > 1")
    placed = dealt.join(large, "place", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select(
        "place", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), (F.col("part") > F.col("other")).cast("int").alias("side"),
        "rep", "copies", "vector", "buckets", "bucket_table", "bucket",
    )
    keys = ["place", "part_a", "part_b"]
    found = cut_lineage(pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(scheme, least), FOUND))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    components = connected_components(found.where("kind = 1").select("a", "b"))
    known = distinct.join(counts, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("embedding").alias("e"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    joined = rows.join(known, F.when(F.col("sound"), F.col("embedding")) == F.col("e"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
