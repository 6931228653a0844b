"""Cutting text into the pieces that a byte-level BPE works on, for a whole chunk at once.

The pieces are those of the public pattern of byte-level BPE:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
found from runs of one character class instead of by a regular expression.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

from folia.llm.columns import characters

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# What the pattern's \s matches, and the short endings that are pieces of their own.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point, made once in a process."""
    if not _CLASSES:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for cp in characters():
            kind = kinds.get(unicodedata.category(chr(cp))[0])
            if kind:
                table[cp] = kind
        table[SPACES] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def piece_starts(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted places at which a piece begins; the texts are points[offs[k]:offs[k + 1]]."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)  # the first character of a text
    first[offs[:-1]] = True
    first = first[:n]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first

    # The last white space before something else stands alone, or joins it if it is a blank.
    space = kind == SPACE
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    start[before] = True
    joined = before[points[before] == 0x20] + 1
    start[joined] = False

    # An apostrophe of its own before a letter may begin one of the short endings.
    quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & start[1:] & (kind[1:] == LETTER) & ~first[1:])
    if len(quote):
        quote = quote[quote + 1 < n]
        one = points[quote + 1]
        inside = quote + 2 < n
        two_at = np.minimum(quote + 2, n - 1)
        two = np.where(inside & ~first[two_at], points[two_at], 0)
        size = np.zeros(len(quote), np.int64)
        for text in ENDINGS:
            hit = one == ord(text[0])
            if len(text) == 2:
                hit = hit & (two == ord(text[1]))
            size[hit] = len(text)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)
