"""Additive moments: all a linear model needs from the rows, in one distributed pass.

For predictors x and target y, every task takes the co-moments of (y, x) per year around the means of its own rows, as one packed
state per year. The states meet pairwise in a tree of tasks (means shift, co-moments gain the distance of the means), so one pass
over the rows keeps all digits, also where a mean is large against the spread. Training moments of every
expanding fold are prefix sums over years, so tuning never re-reads the rows per candidate or fold.

What reaches the driver is one packed state per year: years x (p + 3)^2 / 2 numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that one task of the merging tree takes in, and its levels: 64 ** 3 tasks at most meet in the last.
FAN_IN, LEVELS = 64, 3


@dataclass
class Moments:
    """Cross products of z = (1, y, x1..xp), taken around ``shift`` to keep digits."""

    cross: np.ndarray
    shift: np.ndarray

    @property
    def n(self) -> float:
        return float(self.cross[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Means of (y, x) in original units and their population covariance matrix."""
        means = self.cross[0, 1:] / self.n
        cov = self.cross[1:, 1:] / self.n - np.outer(means, means)
        return means + self.shift, cov


PACKED = "period int, slot int, cells binary"


class State:
    """Layout of a packed state of ``width`` columns: rows, missing values per column, means, upper triangle of the co-moments."""

    def __init__(self, width: int):
        self.width = width
        self.i, self.j = np.triu_indices(width)
        self.lacking, self.means, self.triangle = slice(1, 1 + width), slice(1 + width, 1 + 2 * width), slice(1 + 2 * width, None)

    def of(self, block: np.ndarray) -> np.ndarray:
        mean = block.mean(axis=0)
        centred = block - mean
        return np.concatenate([[len(block)], np.isnan(block).sum(axis=0), mean, (centred.T @ centred)[self.i, self.j]])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The state of both row sets."""
        apart, total = b[self.means] - a[self.means], a + b
        total[self.means] = a[self.means] + apart * (b[0] / total[0])
        total[self.triangle] += apart[self.i] * apart[self.j] * (a[0] * b[0] / total[0])
        return total

    def cross(self, state: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Cross products of (1, columns - shift)."""
        apart, moments = state[self.means] - shift, np.zeros((self.width, self.width))
        moments[self.i, self.j] = moments[self.j, self.i] = state[self.triangle]
        out = np.empty((self.width + 1, self.width + 1))
        out[0, 0], out[0, 1:], out[1:, 0] = state[0], state[0] * apart, state[0] * apart
        out[1:, 1:] = moments + state[0] * np.outer(apart, apart)
        return out


def _merged(layout: State):
    """Merge the states of each (period, slot) of a sorted stream, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for period, slot, cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = np.frombuffer(cells)
                if (period, slot) == key:
                    total = layout.merge(total, part)
                    continue
                if key is not None:
                    yield _row(*key, total)
                key, total = (period, slot), part
        if key is not None:
            yield _row(*key, total)

    return run


def _row(period: int, slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([period], pa.int32()), pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["period", "slot", "cells"])


def packed_states(df: DataFrame, period: str, predictors: Sequence[str], target: str) -> DataFrame:
    """One row per period: the packed ``State`` of (target, predictors). One pass; a missing value is counted and spoils its column."""
    names = [target, *predictors]
    layout = State(len(names))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z, periods = batch[names].to_numpy(dtype=float), batch["__period"].to_numpy()
            for p in np.unique(periods):
                part = layout.of(z[periods == p])
                total[int(p)] = layout.merge(total[int(p)], part) if int(p) in total else part
        slot = TaskContext.get().partitionId() % FAN_IN**LEVELS
        for p, state in total.items():
            yield pd.DataFrame({"period": [p], "slot": [slot], "cells": [state.tobytes()]})

    data = df.select(F.col(period).cast("int").alias("__period"), *[F.col(c).cast("double").alias(c) for c in names])
    parts = data.mapInPandas(products, PACKED)
    for _ in range(LEVELS):
        parts = parts.select("period", F.expr(f"slot div {FAN_IN}").cast("int").alias("slot"), "cells")
        parts = parts.repartition("period", "slot").sortWithinPartitions("period", "slot").mapInArrow(_merged(layout), PACKED)
    return parts.select("period", "cells")


def period_moments(df: DataFrame, period: str, predictors: Sequence[str], target: str, shift: Sequence[float]) -> DataFrame:
    """Rows (period, i, j, value), i <= j: the cross products of (1, target, predictors) less ``shift``."""
    layout, offset = State(len(predictors) + 1), np.asarray(shift, dtype=float)
    i, j = np.triu_indices(len(predictors) + 2)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, packed in zip(batch["period"], batch["cells"], strict=True):
                yield pd.DataFrame({"period": p, "i": i, "j": j, "value": layout.cross(np.frombuffer(packed), offset)[i, j]})

    return packed_states(df, period, predictors, target).mapInPandas(cells, "period int, i int, j int, value double")


def _refuse_missing(rows: int, lacking: dict[str, int], label: str) -> None:
    lacking = {c: int(n) for c, n in lacking.items() if n}
    if lacking:
        raise ValueError(f"{label}: missing values of {int(rows)} rows: {lacking}")


def require_complete(df: DataFrame, columns: Sequence[str], label: str = "sample") -> list[float]:
    """Column means; raises if a value is missing, as rows are never left out of a fit or forecast without a word."""
    doubles = [F.col(c).cast("double") for c in columns]
    row = df.agg(F.count(F.lit(1)), *[F.count(F.when(~F.isnan(d), d)) for d in doubles], *[F.avg(d) for d in doubles]).first()
    _refuse_missing(row[0], {c: row[0] - n for c, n in zip(columns, row[1 : len(doubles) + 1], strict=True)}, label)
    return [0.0 if m is None else float(m) for m in row[len(doubles) + 1 :]]


def fold_moments(df: DataFrame, time: str, predictors: Sequence[str], target: str) -> dict[int, Moments]:
    """Moments per calendar year around the means of all rows, and the check for missing values, in one pass over the rows."""
    names = [target, *predictors]
    layout = State(len(names))
    packed = packed_states(df.select(F.year(time).alias("__year"), *names), "__year", predictors, target)
    states = {row.period: np.frombuffer(row.cells) for row in packed.collect()}
    if not states:
        return {}
    rows = sum(s[0] for s in states.values())
    _refuse_missing(rows, dict(zip(names, sum(s[layout.lacking] for s in states.values()), strict=True)), "sample")
    shift = sum(s[0] * s[layout.means] for s in states.values()) / rows
    return {year: Moments(layout.cross(s, shift), shift) for year, s in states.items()}


def combine(parts: Sequence[Moments]) -> Moments:
    """Moments of the union of disjoint row sets."""
    return Moments(np.sum([m.cross for m in parts], axis=0), parts[0].shift)
