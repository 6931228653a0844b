"""Text columns of Arrow batches as numpy arrays of code points, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once: small enough for the caches, large enough for numpy.
CHUNK_BYTES = 1 << 20


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array with 32-bit offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array from string_array; offsets begin at 0."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    _, offs = raw_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """(code points, row offsets into them, the same as one str). Bytes that aren't UTF-8 become U+FFFD."""
    flat, offs = raw_bytes(column)
    data = flat.tobytes()
    try:
        whole = data.decode("utf-8")
    except UnicodeDecodeError:
        parts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return code_points(pa.array(parts, pa.string()))
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    if len(points) == len(flat):
        return points, offs, whole
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum((flat & 0xC0) != 0x80, out=before[1:])
    return points, before[offs], whole


def strings(points: np.ndarray, offs: np.ndarray) -> pa.Array:
    """The texts whose code points these are."""
    data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) != len(points):
        width = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int8) + (points > 0xFFFF), out=width[1:])
        offs = width[offs]
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data))


def characters() -> Iterator[int]:
    """Code points that may be characters with properties of their own: all but the planes that are empty or for private use."""
    yield from range(0x40000)
    yield from range(0xE0000, 0xF0000)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. n - 1 of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    """64-bit hashes of values[start:end] for all spans at once, by prefix sums of a polynomial; another ``salt`` gives other hashes."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values + np.uint64(salt)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])
