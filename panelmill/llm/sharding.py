"""Shards of nearly equal bytes by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import cut_lineage


def deal(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of one ``size`` each shard gets, if each goes to the least loaded shard (ties: lowest number); ``loads`` are brought up to date.

    A few go one by one through a heap. Many are dealt in bulk: the k-th that a shard gets stands at load + (k - 1) * size, and the heap hands out the n smallest of these
    places, so the level below which all are taken is found by bisection.
    """
    counts = [0] * len(loads)
    if n <= 4 * len(loads) or not size:
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n if size else 0):
            load, shard = heapq.heappop(heap)
            counts[shard] += 1
            heapq.heappush(heap, (load + size, shard))
        if not size:
            counts[heap[0][1]] = n  # groups without bytes leave all loads as they are
    else:

        def taken(level: int) -> list[int]:
            return [max(0, (level - load) // size + 1) for load in loads]

        low, high = min(loads) - 1, max(loads) + n * size
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(taken(middle)) <= n else (low, middle)
        counts = taken(low)
        rest = n - sum(counts)
        for shard, load in enumerate(loads):
            if rest and (low + 1 - load) % size == 0 and low + 1 >= load:
                counts[shard] += 1
                rest -= 1
    for shard, k in enumerate(counts):
        loads[shard] += k * size
    return counts


def longest_first(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """For (size, number of groups) classes: the groups that each shard gets, scheduled from the largest size on."""
    loads = [0] * shards
    return {size: deal(loads, size, n) for size, n in sorted(classes, reverse=True)}


def _rank(rows: DataFrame, within: list[str], order: list[str], units: Column, out: str) -> DataFrame:
    """Add ``out``, numbers from 0 without gaps within ``within``, dealt in ``units`` so that no large class is numbered in one task."""
    spread = rows.withColumn("_unit", F.pmod(F.xxhash64(F.lit(13), *order), units))
    counts = spread.groupBy(*within, "_unit").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_unit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(*within, "_unit").orderBy(*order))
    numbered = spread.withColumn("_number", number).join(offsets, [*within, "_unit"])
    return numbered.withColumn(out, (F.col("_offset") + F.col("_number") - 1).cast("long")).drop("_unit", "_number", "_offset")


def shard_by_size(rows: DataFrame, group: str, size: str, order: list[str], shards: int, unit_rows: int = 500_000) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard); rows of a group stay together.

    Every group is scheduled, from the largest on, to the least loaded shard. Groups of one size are alike for that, so the driver schedules classes (size, number of groups): different
    sizes that add up to no more than all bytes number at most the root of twice the bytes, 14 million at 100 TB. A group finds its shard by its rank within
    its size. Ranks and slots are numbered in units of about ``unit_rows``. NULL groups form one group; NULL sizes count as 0; an empty table gives no rows.
    """
    spark = rows.sparkSession
    own = rows.columns
    # Groups are told apart by 128 bits of hash; the NULL group by a flag.
    keys = [F.xxhash64(F.lit(k), F.col(group)).alias(f"_g{k}") for k in (1, 2)]
    stored = cut_lineage(rows.select("*", *keys, F.col(group).isNull().alias("_none")))
    key = ["_g1", "_g2", "_none"]
    groups = cut_lineage(stored.groupBy(*key).agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("_size"), F.count("*").alias("_rows")))
    classes = [(r["_size"], r["n"]) for r in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    plan = []
    for bytes_, counts in longest_first(classes, shards).items():
        upto, bounds = 0, []
        for shard, n in enumerate(counts):
            if n:
                upto += n
                bounds.append((upto, shard))
        plan.append((bytes_, -(-upto // unit_rows), bounds))
    table = spark.createDataFrame(plan, "_size long, _units long, _bounds array<struct<upto:long,shard:int>>")
    ranked = _rank(groups.join(table, "_size"), ["_size"], ["_g1", "_g2", "_none"], F.col("_units"), "_rank")
    placed = ranked.select(*key, "_rows", F.filter("_bounds", lambda b: F.col("_rank") < b["upto"])[0]["shard"].alias("shard"))
    placed = cut_lineage(placed)
    # One row per shard.
    units = F.broadcast(placed.groupBy("shard").agg(F.ceil(F.sum("_rows") / unit_rows).cast("long").alias("_units")))
    named = stored.join(placed.drop("_rows"), key).join(units, "shard")
    return _rank(named, ["shard"], order, F.col("_units"), "slot").select(*own, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of ``docs`` (doc_id, text; other columns are ignored) under the law of nearly equal bytes.

    Size: bytes of the text plus 8; a NULL text has none and counts as equal to the empty one. Equal texts share a shard.
    Repeated rows are kept, each with its own slot. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_text"),
    )
    placed = shard_by_size(rows, "_text", "size", ["doc_id", "_text"], shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
