"""Bit filters over keys: which of many keys may be in a set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import mix

#: Bits for each key, and the most bits of a filter (32 MB), which bounds what the driver and the tasks hold.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    spread, mask = mix(keys.astype(np.int64, copy=False).view(np.uint64)), np.uint64(bits - 1)
    return (spread & mask).astype(np.int64), ((spread >> np.uint64(34)) & mask).astype(np.int64)


class KeyFilter:
    """Two bits per key in a table whose length is a power of two. Keys of the set always pass; of others about 1 in 70 at the planned load."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in _places(keys, self.bits):
            out &= (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def key_filter(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS) -> KeyFilter:
    """Filter of a long column of a stored table, sized from its count. Beyond ``most_bits`` it grows no further and lets more keys pass, but holds none back."""
    bits = 1 << 16
    wanted = keys.count() * bits_per_key
    while bits < min(wanted, most_bits):
        bits *= 2
    made = KeyFilter(bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(_places(batch.column(0).drop_null().to_numpy(), bits))
            words, where = np.unique(place >> 6, return_inverse=True)
            masks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(masks, where, np.uint64(1) << (place & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks.view(np.int64))], ["word", "mask"])

    got = keys.mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    made.words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return made
