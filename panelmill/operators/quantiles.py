"""Exact group quantiles by radix counts.

Doubles are read as 64-bit codes of the same order. Tasks count, per group and column, the leading 16 bits of the codes; the counts say in which bin a wanted order
statistic lies. A second pass sends the values of these bins alone, a few percent of the cells, or, where a bin is too full, counts its next 16 bits. So every
statistic is found exactly after two to five passes, groups may have any size, and cells are neither shuffled nor made into rows: what travels is one
packed vector per task, group and column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.session import cut_lineage

#: Bins of at most so many values are sent as values.
GATHER = 50_000
#: So many wanted bins at most are sent to all tasks; more are joined to the rows of their group.
MOST_BINS = 1 << 19
#: A task sends its counts when they fill so many cells.
HELD = 2_000_000
_SIGN = np.uint64(1 << 63)

Wanted = list[tuple[str, float]]


def codes_of(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; -0.0 and 0.0 are the same."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN != 0, ~bits, bits | _SIGN)


def values_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes & _SIGN != 0, codes & ~_SIGN, ~codes).view(np.float64)


# --- which order statistics make up a quantile -----------------------------------------
def _ranks(kind: str, p: float, n: int, total: int) -> tuple[int, int, float]:
    """0-based ranks around quantile ``p`` of the n present values, and the interpolation weight.

    Kind ``imputed``: of the sample in which every missing value is replaced by the median. The filled-in copies of the median form a block right
    after the lower middle value, so its order statistics are those of the present values, or the median itself (rank -1).
    """
    size = n if kind == "plain" else total
    h = (size - 1) * p
    low = int(np.floor(h))
    high = min(low + 1, size - 1)
    if kind == "plain":
        return low, high, h - low
    start, missing = (n - 1) // 2 + 1, total - n

    def present(rank: int) -> int:
        return rank if rank < start else -1 if rank < start + missing else rank - missing

    return present(low), present(high), h - low


SENT = "k string, j int, kind int, rows long, a binary, b binary"
PLAN = "k string, j int, n long, total long, depth int, prefix array<long>, base array<long>, size array<long>, found array<double>"
_PLAN = [c.split()[0] for c in PLAN.split(", ")]


def _packed(gid: np.ndarray, data: np.ndarray, groups: int) -> pa.Array:
    """One binary per group of the rows of ``data``, which are sorted by group."""
    ends = np.searchsorted(gid, np.arange(groups + 1)) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class _Counts:
    """Counts of (group, code prefix) of one column in a task."""

    def __init__(self) -> None:
        self.key, self.prefix, self.n, self.size = [], [], [], 0

    def add(self, gid: np.ndarray, prefix: np.ndarray) -> None:
        # Keys of 16-bit bins fit one number with the group; deeper prefixes are sorted by two.
        order = np.lexsort((prefix, gid))
        gid, prefix = gid[order], prefix[order]
        new = np.ones(len(gid), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (prefix[1:] != prefix[:-1])
        heads = np.flatnonzero(new)
        self.key.append(gid[heads])
        self.prefix.append(prefix[heads])
        self.n.append(np.diff(np.append(heads, len(gid))))
        self.size += len(heads)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.key:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        gid, prefix, n = np.concatenate(self.key), np.concatenate(self.prefix), np.concatenate(self.n)
        order = np.lexsort((prefix, gid))
        gid, prefix, n = gid[order], prefix[order], n[order]
        new = np.ones(len(gid), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (prefix[1:] != prefix[:-1])
        heads = np.flatnonzero(new)
        return gid[heads], prefix[heads], np.add.reduceat(n, heads) if len(heads) else n


def _first_counts(width: int):
    """Counts of the leading 16 bits per group and column, and the rows per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        rows, held = np.zeros(0, np.int64), [_Counts() for _ in range(width)]

        def sent() -> Iterator[pa.RecordBatch]:
            keys, m = list(names), len(names)
            for j, counts in enumerate(held):
                gid, prefix, n = counts.merged()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array([j] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.array(rows), _packed(gid, prefix, m), _packed(gid, n, m)],
                    [c.split()[0] for c in SENT.split(", ")],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            gid = np.array([names.setdefault(k, len(names)) for k in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            rows = np.pad(rows, (0, len(names) - len(rows))) + np.bincount(gid, minlength=len(names))
            for j in range(width):
                column = batch.column(1 + j)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                held[j].add(gid[there], codes_of(column.drop_null().to_numpy()) >> np.uint64(48))
            if sum(c.size for c in held) > HELD:
                yield from sent()
                names, rows, held = {}, np.zeros(0, np.int64), [_Counts() for _ in range(width)]
        if names:
            yield from sent()

    return run


def _next_step(width: int, depth: int, shared=None):
    """For the bins that are wanted at ``depth`` bits: their values, or counts of 16 bits more. ``shared`` has them by group; without it the last column of a row packs its group's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - depth)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            keys, gid = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            if shared is None:
                own = [batch.column(1 + width)[int(i)].as_py() for i in np.unique(gid, return_index=True)[1]]
            else:
                own = [shared.value.get(k, ()) for k in keys]
            slots = max((len(x["prefix"]) for plan in own for x in plan), default=0)
            if not slots:
                continue
            # Prefixes of the wanted bins by group, column and slot; no code has the prefix 2**64 - 1 at depths below 64.
            bins = np.full((len(keys), width, slots), np.uint64(2**64 - 1))
            full = np.zeros((len(keys), width, slots), bool)
            for g, plan in enumerate(own):
                for x in plan:
                    bins[g, x["j"], : len(x["prefix"])] = np.array(x["prefix"], np.int64).view(np.uint64)
                    full[g, x["j"], : len(x["prefix"])] = np.array(x["size"]) > GATHER
            for j in range(width):
                column = batch.column(1 + j)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                codes = codes_of(column.drop_null().to_numpy())
                hit = (codes >> shift)[:, None] == bins[gid[there], j]
                deeper = (hit & full[gid[there], j]).any(1)
                for kind, mine in ((1, hit.any(1) & ~deeper), (0, deeper)):
                    if not mine.any():
                        continue
                    group, code = gid[there[mine]], codes[mine]
                    if kind:
                        order = np.argsort(group, kind="stable")
                        group, a = group[order], code[order]
                        b = np.zeros(0, np.int64)
                    else:
                        counts = _Counts()
                        counts.add(group, code >> (shift - np.uint64(16)))
                        group, a, b = counts.merged()
                    seen, m = np.unique(group), len(keys)
                    columns = [
                        pa.array(keys, pa.string()), pa.array([j] * m, pa.int32()), pa.array([kind] * m, pa.int32()), pa.array([0] * m, pa.int64()),
                        _packed(group, a, m), _packed(group if not kind else group[:0], b, m),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SENT.split(", ")]).take(pa.array(seen))

    return run


def _located(ranks: list[int], prefix: np.ndarray, n: np.ndarray, base: int = 0) -> list[tuple[int, int, int]]:
    """(prefix, values before it, values in it) of the bin of each rank."""
    upto = np.cumsum(n)
    at = np.searchsorted(upto, np.array(ranks) - base, side="right")
    return [(int(prefix[i : i + 1].view(np.int64)[0]), int(upto[i] - n[i]) + base, int(n[i])) for i in at.tolist()]


def _solve(wanted: Wanted, depth: int):
    """From counts, values and plans of (group, column), sorted by these: the next plan. ``found`` has a value per rank, NaN where it is still sought."""

    def asked(n: int, total: int) -> list[int]:
        return sorted({r for kind, p in wanted if n for r in _ranks(kind, p, n, total)[:2] if r >= 0})

    def step(rows: list[tuple]) -> tuple:
        """``rows``: (k, j, kind, rows, a, b); kind 2 is the plan so far."""
        k, j = rows[0][:2]
        plan = next((r[6] for r in rows if r[2] == 2), None)
        counted = [r for r in rows if r[2] == 0]
        prefix = np.concatenate([np.frombuffer(r[4], np.uint64) for r in counted]) if counted else np.zeros(0, np.uint64)
        n = np.concatenate([np.frombuffer(r[5], np.int64) for r in counted]) if counted else np.zeros(0, np.int64)
        prefix, where = np.unique(prefix, return_inverse=True)
        n = np.bincount(where, weights=n, minlength=len(prefix)).astype(np.int64)
        if plan is None:
            size, total = int(n.sum()), sum(r[3] for r in rows)
            ranks = asked(size, total)
            bins = _located(ranks, prefix, n) if ranks else []
            return (k, j, size, total, 16, *map(list, zip(*bins, strict=True)), [float("nan")] * len(ranks)) if ranks else (k, j, size, total, 16, [], [], [], [])
        size, total, bins, sizes, bases, found = plan
        ranks = asked(size, total)
        values = np.sort(np.concatenate([np.frombuffer(r[4], np.uint64) for r in rows if r[2] == 1] or [np.zeros(0, np.uint64)]))
        new = []
        for at, (rank, p, base, m) in enumerate(zip(ranks, bins, bases, sizes, strict=True)):
            if not np.isnan(found[at]):
                new.append((p, base, m))
                continue
            low = np.array([p], np.int64).view(np.uint64)[0] << np.uint64(64 - depth)
            if m <= GATHER:
                start = int(np.searchsorted(values, low))
                found[at] = float(values_of(values[start + rank - base : start + rank - base + 1])[0])
                new.append((p, base, m))
            else:
                inside = prefix >> np.uint64(16) == np.array([p], np.int64).view(np.uint64)[0]
                (q, before, count), = _located([rank], prefix[inside], n[inside], base)
                if depth + 16 == 64:
                    found[at] = float(values_of(np.array([q], np.int64).view(np.uint64))[0])
                new.append((q, before, count))
        # Ranks found earlier keep their bins; their prefixes are not looked for again.
        return (k, j, size, total, depth + 16, *map(list, zip(*new, strict=True)), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.float64())]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], _PLAN)

        for part in batches:
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                row = (*row[:6], tuple(row[6].values()) if len(row) > 6 and row[6] is not None else None)
                if held and row[:2] != held[0][:2]:
                    out.append(step(held))
                    held = []
                    if len(out) == 1000:
                        yield batch()
                        out = []
                held.append(row)
        if held:
            out.append(step(held))
        if out:
            yield batch()

    return run


def _cells(wanted: Wanted):
    """The ranks, weights and values of every wanted quantile from the solved plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("weight", pa.float64()), ("low_value", pa.float64()), ("high_value", pa.float64())]))
        for batch in batches:
            out = []
            for n, total, found in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "total", "found")], strict=True):
                asked = [_ranks(kind, p, n, total) if n else (0, 0, 0.0) for kind, p in wanted]
                value = dict(zip(sorted({r for low, high, _ in asked for r in (low, high) if n and r >= 0}), found, strict=True))
                out.append([{"low": low, "high": high, "weight": w, "low_value": value.get(low), "high_value": value.get(high)} for low, high, w in asked])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, cell)], ["k", "j", "n", "total", "__cells"])

    return run


_CELLS = "k string, j int, n long, total long, __cells array<struct<low:long,high:long,weight:double,low_value:double,high_value:double>>"


def _order_statistics(df: DataFrame, keys: list[str], cols: list[str], wanted: Wanted, is_stored: bool) -> DataFrame:
    # One text as key: it is equal to itself in a join when a key is NULL.
    key = F.struct(*(keys or [F.lit(0).alias("all")]))
    named = df.select(key.alias("__keys"), F.to_json(key, {"ignoreNullFields": "false"}).alias("k"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)])
    data = named if is_stored else cut_lineage(named)
    width = len(cols)
    values = data.select("k", *[f"x{j}" for j in range(width)])
    counted = values.mapInArrow(_first_counts(width), SENT)
    plan = cut_lineage(counted.repartition("k", "j").sortWithinPartitions("k", "j").mapInArrow(_solve(wanted, 0), PLAN))
    for depth in (16, 32, 48):
        sought = plan.where(F.exists("found", F.isnan))
        if sought.isEmpty():
            break
        # The bins still sought, once each, with their sizes.
        open_ = F.filter(F.arrays_zip("prefix", "size", "found"), lambda x: F.isnan(x["found"]))
        bins = F.array_distinct(F.transform(open_, lambda x: F.struct(x["prefix"].alias("prefix"), x["size"].alias("size"))))
        entry = F.struct("j", F.transform(bins, lambda x: x["prefix"]).alias("prefix"), F.transform(bins, lambda x: x["size"]).alias("size"))
        if sought.count() * 2 * len(wanted) <= MOST_BINS:
            table: dict[str, list] = {}
            for r in sought.select("k", entry.alias("e")).select("k", "e.*").toArrow().to_pylist():
                table.setdefault(r["k"], []).append(r)
            step = values.mapInArrow(_next_step(width, depth, df.sparkSession.sparkContext.broadcast(table)), SENT)
        else:
            per_group = sought.groupBy("k").agg(F.collect_list(entry).alias("bins"))  # one entry per column
            step = values.join(per_group, "k").mapInArrow(_next_step(width, depth), SENT)
        state = F.struct("n", "total", "prefix", "size", "base", "found")
        sent = step.withColumn("plan", F.lit(None).cast(sought.select(state.alias("s")).schema["s"].dataType))
        before = sought.select("k", "j", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), state.alias("plan"))
        solved = sent.unionByName(before).repartition("k", "j").sortWithinPartitions("k", "j").mapInArrow(_solve(wanted, depth), PLAN)
        plan = cut_lineage(plan.where(~F.exists("found", F.isnan)).unionByName(solved))
    cells = plan.mapInArrow(_cells(wanted), _CELLS)
    names = data.groupBy("k").agg(F.any_value("__keys").alias("__keys"))
    feature = F.get(F.array(*[F.lit(c) for c in cols]), F.col("j")).alias("feature")
    return cells.join(names, "k").select(*[F.col("__keys")[c].alias(c) for c in keys], feature, "n", "total", "__cells")


def _interpolated(cell: Column, median: Column | None = None) -> Column:
    low, high = cell["low_value"], cell["high_value"]
    if median is not None:
        low, high = F.when(cell["low"] < 0, median).otherwise(low), F.when(cell["high"] < 0, median).otherwise(high)
    return low + (high - low) * cell["weight"]


def group_quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], probabilities: Sequence[float], prefix: str = "q",
    is_stored: bool = False,
) -> DataFrame:
    """Rows (keys, feature, n, total, ``<prefix>0``...): linearly interpolated exact quantiles, NULLs ignored.

    The input is read a few times: it is stored first unless ``is_stored``.
    """
    keys = list(keys)
    solved = _order_statistics(df, keys, list(cols), [("plain", p) for p in probabilities], is_stored)
    return solved.select(
        *keys, "feature", "n", "total",
        *[_interpolated(F.col("__cells")[i]).alias(f"{prefix}{i}") for i in range(len(probabilities))],
    )


def group_clip_bounds(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], lower: float, upper: float, is_stored: bool = False
) -> DataFrame:
    """Rows (keys, feature, n, total, median, lower, upper).

    ``median`` is that of the present values; the bounds are quantiles of the sample after the missing values
    were replaced by it. One pass solves both, because the filled-in block has a known place.
    """
    keys = list(keys)
    wanted: Wanted = [("plain", 0.5), ("imputed", lower), ("imputed", upper)]
    solved = _order_statistics(df, keys, list(cols), wanted, is_stored)
    out = solved.select(*keys, "feature", "n", "total", "__cells", _interpolated(F.col("__cells")[0]).alias("median"))
    return out.select(
        *keys, "feature", "n", "total", "median",
        _interpolated(F.col("__cells")[1], F.col("median")).alias("lower"),
        _interpolated(F.col("__cells")[2], F.col("median")).alias("upper"),
    )
