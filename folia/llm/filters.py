"""Fixed-size filters and counters of 64-bit hashes, filled by all tasks and merged on executors.

A filter only saves work: it lets through all that was put in and a few more, and whatever passes meets an
exact join. Their sizes follow a count made before and end at a limit; beyond it more gets through, never less.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from folia.llm.columns import mix64
from folia.session import map_arrow

#: log2 of the bits of a filter at most (16 MB), and of the counters of a table of counts (4 MB).
MOST_BITS, MOST_COUNTERS = 27, 22
PROBES, BITS_PER_KEY = 4, 12
SEGMENT = 1 << 16

Batches = Iterator[pa.RecordBatch]


def log_bits(n_keys: int, per_key: int = BITS_PER_KEY, least: int = 19, most: int = MOST_BITS) -> int:
    """log2 of the places for so many keys, within the limits."""
    return min(most, max(least, int(n_keys * per_key).bit_length()))


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of each key, one probe after another."""
    at = mix64(keys.view(np.uint64))
    step = mix64(at) | np.uint64(1)
    for _ in range(PROBES):
        yield (at >> np.uint64(64 - bits)).astype(np.int64)
        at = at + step


def add_keys(table: np.ndarray, keys: np.ndarray) -> None:
    """Put keys into the bits of a filter."""
    bits = len(table).bit_length() + 2
    for place in _places(keys, bits):
        np.bitwise_or.at(table, place >> 3, np.left_shift(np.uint8(1), (place & 7).astype(np.uint8)))


def among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have been put in; True for all that were."""
    bits = len(table).bit_length() + 2
    out = np.ones(len(keys), bool)
    left = np.arange(len(keys))
    for place in _places(keys, bits):
        # keys already out aren't looked up again
        hit = (table[place[left] >> 3] >> (place[left] & 7).astype(np.uint8)) & 1 > 0
        out[left[~hit]] = False
        left = left[hit]
    return out


def counter_places(n_counters: int, keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) >> np.uint64(65 - n_counters.bit_length())).astype(np.int64)


def to_log(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: eight steps for a doubling, order kept."""
    return np.minimum(255, np.ceil(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _or_into(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    return part.copy() if total is None else np.bitwise_or(total, part, out=total)


def _add_logs(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    counts = np.exp2(part / 8.0) - 1
    return counts if total is None else np.add(total, counts, out=total)


def gather(df: DataFrame, fill: Callable[[Batches, np.ndarray], np.ndarray], size: int, counts: bool = False) -> Broadcast:
    """A table of ``size`` bytes from all of ``df``: ``fill`` fills one for each task, they are merged in segments on
    executors (bits by or, counts by sum), and the merged table goes to all. Only that, of a bounded size, passes the driver."""
    merge = _add_logs if counts else _or_into
    width = min(SEGMENT, size)

    def part(batches: Batches) -> Batches:
        table = fill(batches, np.zeros(size, np.uint8))
        for k in range(size // width):
            piece = table[k * width : (k + 1) * width]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], ["k", "data"])

    def whole(batches: Batches) -> Batches:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = merge(totals.get(k), np.frombuffer(zlib.decompress(data), np.uint8))
        for k, table in totals.items():
            table = to_log(table) if counts else table
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["k", "data"])

    parts = map_arrow(df, part, "k int, data binary").repartition(min(16, max(1, size // width)), "k")
    table = np.zeros(size, np.uint8)
    for k, data in map_arrow(parts, whole, "k int, data binary").collect():
        table[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(data), np.uint8)
    return df.sparkSession.sparkContext.broadcast(table)


def filter_of(keys: DataFrame, n_keys: int, most: int = MOST_BITS) -> Broadcast:
    """A filter of the one bigint column of ``keys``, of which there are ``n_keys`` or fewer."""

    def fill(batches: Batches, table: np.ndarray) -> np.ndarray:
        for batch in batches:
            add_keys(table, batch.column(0).to_numpy(zero_copy_only=False))
        return table

    return gather(keys, fill, 1 << (log_bits(n_keys, most=most) - 3))


def passing(df: DataFrame, column: str, shipped: Broadcast) -> DataFrame:
    """Rows whose bigint ``column`` may be in the filter; it must not be null."""
    at = df.columns.index(column)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            hit = np.flatnonzero(among(shipped.value, batch.column(at).to_numpy(zero_copy_only=False)))
            if len(hit):
                yield batch.take(pa.array(hit))

    return map_arrow(df, run, df.schema)
