"""Words and word shingles of a chunk of texts, as hashes in numpy arrays."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from folia.llm.columns import characters, chunks, code_points, mix64, span_hashes, string_array

# Blanks, tabs and line breaks that separate words.
SEPARATORS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]

_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """lower: code point -> its lower case of one character; word: whether it isn't a separator; alnum: whether it's a letter or number."""
    if not _TABLES:
        top = sys.maxunicode + 1
        lower = np.arange(top, dtype=np.uint32)
        alnum = np.zeros(top, bool)
        for cp in characters():
            ch = chr(cp)
            if unicodedata.category(ch)[0] in "LN":
                alnum[cp] = True
            low = ch.lower()
            if low != ch and len(low) == 1:
                lower[cp] = ord(low)
        word = np.ones(top, bool)
        word[SEPARATORS] = False
        _TABLES.update(lower=lower, alnum=alnum, word=word)
    return _TABLES[name]


def word_spans(points: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code points, starts, ends, offsets of each text's words) for kind ``word`` or ``alnum``."""
    low = _table("lower")[points]
    n = len(low)
    on = np.zeros(n + 1, bool)
    on[:n] = _table(kind)[low]
    head = np.zeros(n + 1, bool)
    head[offs] = True
    change = on.copy()
    change[1:] &= ~on[:-1] | head[1:]
    starts = np.flatnonzero(change)
    last = on.copy()
    last[:-1] &= ~on[1:] | head[1:]
    ends = np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(points: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)."""
    low, starts, ends, rows = word_spans(points, offs, kind)
    return span_hashes(low.astype(np.uint64), starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``width`` consecutive words, in order; texts with fewer words have none."""
    count = np.maximum(np.diff(rows) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(rows[:-1], count)
    return span_hashes(words, at, at + width), text


def distinct_shingles(points: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets by text) of the distinct shingles of each text, sorted within it."""
    words, rows = word_hashes(points, offs, "word")
    hashes, text = shingles(words, rows, width)
    order = np.argsort(hashes)
    order = order[by_group(text[order], len(offs))]
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(offs)))


def by_group(group: np.ndarray, n: int) -> np.ndarray:
    """A stable order by numbers below n; of 16 bits they are sorted by radix."""
    return np.argsort(group.astype(np.uint16) if n <= 1 << 16 else group, kind="stable")


def first_of_class(c1: np.ndarray, c2: np.ndarray, seen: set, most: int = 500_000) -> np.ndarray:
    """Places of sets, by their digests, that ``seen`` lacks, each once; it then has them. It is emptied when full: later
    copies then come again, which costs work and changes nothing."""
    if len(seen) > most:
        seen.clear()
    out = []
    for k, key in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
        if key not in seen:
            seen.add(key)
            out.append(k)
    return np.array(out, np.int64)


def take_sets(hashes: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place in ``keep``) of the sets at these places."""
    n = offs[keep + 1] - offs[keep]
    ends = np.cumsum(n)
    at = np.repeat(offs[keep] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)
    return hashes[at], np.repeat(np.arange(len(keep)), n)


def set_digests(hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: equal sets have equal ones."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix64(hashes ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[offs[1:]] - sums[offs[:-1]]).view(np.int64))
    return out[0], out[1]


def sets_at(hashes: np.ndarray, offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the sets at these places, one after another; a place may come again and again."""
    taken, _ = take_sets(hashes, offs, at)
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(offs[at + 1] - offs[at], out=ends[1:])
    return taken, ends


def common_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Size of the intersection of the k-th sets of two columns of distinct shingles."""
    n = len(left[1]) - 1
    hashes = np.concatenate([left[0], right[0]])
    row = np.concatenate([np.repeat(np.arange(n), np.diff(x[1])) for x in (left, right)])
    order = np.argsort(hashes)
    order = order[by_group(row[order], n)]
    hashes, row = hashes[order], row[order]
    twice = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][twice], minlength=n)


def as_lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow list column of signed 64-bit numbers."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))


def slices(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the code points and row offsets of their text column."""
    for batch in batches:
        texts = string_array(batch.column(text_at))
        for lo, hi in chunks(texts):
            points, offs, _ = code_points(texts.slice(lo, hi - lo))
            yield batch.slice(lo, hi - lo), points, offs
