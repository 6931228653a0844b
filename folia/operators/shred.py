"""Nested OCR payloads as flat, linked tables, by vectorised structural indexing of many payloads at once.

Bitmaps of quotes, brackets and delimiters over the bytes of a chunk of payloads give strings by prefix
parity and nesting depth by prefix sums; spans, their containers and keys follow by sorting, and the
fields of all entries are then looked up together. JSON and Python literals have the same structure.
Payloads with anything out of the ordinary (such as tuples or adjacent strings) are parsed one by one instead.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.session import map_arrow

CHUNK_BYTES = 1 << 20
OBJECT, ARRAY, STRING, NUMBER, NULL, BOOL = 1, 3, 10, 11, 12, 13
_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COLON, _COMMA, _BLANK, _SCALAR, _OTHER = range(1, 10)

# Field names of the payloads, and those of each side of a box in order of preference.
FIELDS = [
    "tokens", "blocks", "pages", "lines", "paragraphs", "ocr_boxes", "doc_offset", "start", "end", "position", "page_num", "page_id",
    "segments", "segment", "bbox", "text", "points", "size", "dimension", "width", "height",
    "left", "bbLeft", "x0", "top", "bbTop", "y0", "right", "bbRight", "x1", "bottom", "bbBot", "y1",
    "page", "pageNumber", "page_index", "dimensions", "page_width", "page_height", "text_offset", "offset", "bounding_box", "boundingBox", "x", "y",
]
SIDES = [["left", "bbLeft", "x0"], ["top", "bbTop", "y0"], ["right", "bbRight", "x1"], ["bottom", "bbBot", "y1"]]
_ID = {name: k for k, name in enumerate(FIELDS)}


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for k, ch in enumerate(b"{}[]:,"):
        table[ch] = k + 1
    table[list(b" \t\n\r")] = _BLANK
    table[list(b"0123456789+-.eE" + b"nulltruefalseNoneTrueFalse")] = _SCALAR
    return table


_CLASS = _byte_classes()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Index:
    """Values of all payloads of a chunk, by the place of their first token; -1 stands for no value."""

    flat: np.ndarray
    kind: np.ndarray  # by token: OBJECT, ARRAY, STRING, NUMBER, NULL, BOOL or 0
    row: np.ndarray
    start: np.ndarray  # span of a string's content or a scalar
    end: np.ndarray
    root: np.ndarray  # by row: the payload's value, -1 if unreadable
    odd: np.ndarray  # by row: to be parsed one by one
    keyed: np.ndarray  # sorted container * fields + field, and the value; the last of equal keys counts
    keyed_value: np.ndarray
    child: np.ndarray  # values in order of container and place
    first: np.ndarray  # by token: where its children begin in ``child``; one more at the end

    def get(self, at: np.ndarray, name: str) -> np.ndarray:
        """The value under a key of each object, -1 if there is none; null counts as none."""
        if not len(self.keyed):
            return np.full(len(at), -1)
        key = at.astype(np.int64) * len(FIELDS) + _ID[name]
        place = np.searchsorted(self.keyed, key, "right") - 1
        ok = (place >= 0) & (at >= 0)
        ok &= self.keyed[np.maximum(place, 0)] == key
        value = np.where(ok, self.keyed_value[np.maximum(place, 0)], -1)
        return np.where((value >= 0) & (self.kind[value] != NULL), value, -1)

    def first_of(self, at: np.ndarray, names: list[str]) -> np.ndarray:
        out = self.get(at, names[0])
        for name in names[1:]:
            out = np.where(out >= 0, out, self.get(at, name))
        return out

    def only(self, at: np.ndarray, kind: int) -> np.ndarray:
        return np.where((at >= 0) & (self.kind[at] == kind), at, -1)

    def texts(self, at: np.ndarray) -> np.ndarray:
        """Values that read as text: strings and numbers; -1 for others."""
        return np.where((at >= 0) & np.isin(self.kind[at], (STRING, NUMBER)), at, -1)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Number of elements of each array, 0 for no array."""
        ok = (at >= 0) & (self.kind[at] == ARRAY)
        return np.where(ok, self.first[at + 1] - self.first[at], 0)

    def elements(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``at``, element, its number) of all arrays."""
        n = self.count(at)
        owner = np.repeat(np.arange(len(at)), n)
        return owner, self.child[_ranges(self.first[np.maximum(at, 0)], n)], _ranges(np.zeros(len(at), np.int64), n)

    def element(self, at: np.ndarray, k: int) -> np.ndarray:
        n = self.count(at)
        place = np.where(n > k, self.first[np.maximum(at, 0)] + k, 0)
        return np.where(n > k, self.child[place] if len(self.child) else -1, -1)

    def numbers(self, at: np.ndarray) -> np.ndarray:
        """Numbers, quoted or not, as floats; NaN for all else."""
        out = np.full(len(at), np.nan)
        ok = np.flatnonzero((at >= 0) & np.isin(self.kind[at], (STRING, NUMBER)))
        size = self.end[at[ok]] - self.start[at[ok]]
        for k in ok[(size > 24)]:
            out[k] = _float(self.flat[self.start[at[k]] : self.end[at[k]]].tobytes())
        ok, size = ok[(size > 0) & (size <= 24)], size[(size > 0) & (size <= 24)]
        if not len(ok):
            return out
        cells = np.zeros((len(ok), 24), np.uint8)
        cells[np.repeat(np.arange(len(ok)), size), _ranges(np.zeros(len(ok), np.int64), size)] = self.flat[_ranges(self.start[at[ok]], size)]
        digit = (cells >= 48) & (cells <= 57)
        point = cells == 46
        plain = (digit | point | (cells == 0)).all(axis=1) & (point.sum(axis=1) <= 1) & digit[:, 0] & digit[np.arange(len(ok)), size - 1]
        text = cells.view("S24").reshape(-1)
        out[ok[plain]] = text[plain].astype(np.float64)
        for k in np.flatnonzero(~plain):
            out[ok[k]] = _float(text[k])
        return out

    def text(self, at: int) -> str:
        """A text with escaped characters."""
        raw = self.flat[self.start[at] : self.end[at]].tobytes().decode("utf-8", "replace")
        quote = chr(self.flat[self.start[at] - 1])
        if quote == '"':
            try:
                return json.loads(f'"{raw}"')
            except ValueError:
                pass
        try:
            return ast.literal_eval(f"{quote}{raw}{quote}")
        except (ValueError, SyntaxError):
            return raw

    def strings(self, at: np.ndarray) -> pa.Array:
        """The texts at these places, null for -1, cut from the payloads by offsets; only texts with a backslash are read one by one."""
        known = at >= 0
        start, end = (np.where(known, x[at] if len(x) else 0, 0) for x in (self.start, self.end))
        size = end - start
        flat = self.flat[_ranges(start, size)]
        offs = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        slashes = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(flat == 92, out=slashes[1:])
        valid = pa.array(known).buffers()[1]
        made = pa.StringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()), valid)
        escaped = (slashes[offs[1:]] > slashes[offs[:-1]]) & (self.kind[at] == STRING if len(self.kind) else False)
        if escaped.any():
            made = pc.replace_with_mask(made, pa.array(escaped), pa.array([self.text(k) for k in at[escaped].tolist()], pa.string()))
        return made


def _float(text: bytes) -> float:
    try:
        return float(text)
    except ValueError:
        return np.nan


def _string_quotes(double: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the quotes of rows begin or end a string, where both kinds do: a quote does so outside of strings, and inside
    of one that its own kind began.

    States are outside, in double and in single quotes. Each quote is a map of states; their compositions from
    the begin of the row come by doubling, for all rows at once.
    """
    n = len(double)
    maps = np.where(double[:, None], np.array([1, 0, 2], np.int8), np.array([2, 1, 0], np.int8))
    head = np.searchsorted(row, row)
    step = 1
    while step < n:
        at = np.flatnonzero(np.arange(n) - step >= head)
        if not len(at):
            break
        maps[at] = np.take_along_axis(maps[at], maps[at - step].astype(np.int64), axis=1)
        step *= 2
    before = np.zeros(n, np.int8)
    inner = np.arange(n) > head
    before[inner] = maps[np.flatnonzero(inner) - 1, 0]
    return (before == 0) | (before == np.where(double, 1, 2))


def structural_index(flat: np.ndarray, offs: np.ndarray, plain: bool = False) -> Index:
    """The values of the payloads flat[offs[k]:offs[k + 1]]. ``plain``: they are JSON as _readable writes it, in which
    a key with an escaped character is never one of ours."""
    n_rows, n = len(offs) - 1, len(flat)
    row_of = np.repeat(np.arange(n_rows), np.diff(offs))
    bad, odd = np.zeros(n_rows, bool), np.zeros(n_rows, bool)

    # quotes that begin or end a string
    quotes = np.flatnonzero((flat == 34) | (flat == 39))
    slash = flat == 92
    if slash.any() and len(quotes):
        last = np.maximum.accumulate(np.where(~slash, np.arange(n), -1))
        floor = np.maximum(last[np.maximum(quotes - 1, 0)], offs[row_of[quotes]] - 1)
        quotes = quotes[(np.maximum(quotes - 1, -1) - floor) % 2 == 0]
    q_row = row_of[quotes]
    begin = np.searchsorted(q_row, np.arange(n_rows))
    main = np.full(n_rows, 34, np.uint8)
    have = np.bincount(q_row, minlength=n_rows) > 0
    main[have] = flat[quotes[begin[have]]]
    real = flat[quotes] == main[q_row]
    before = np.cumsum(real) - real
    rank = before - before[begin[q_row]] if len(quotes) else before
    mixed = np.zeros(n_rows, bool)
    mixed[q_row[~real & (rank % 2 == 0)]] = True
    if mixed.any():  # strings in both kinds of quotes
        some = np.flatnonzero(mixed[q_row])
        real[some] = _string_quotes(flat[quotes[some]] == 34, q_row[some])
    quotes, q_row = quotes[real], q_row[real]
    per_row = np.bincount(q_row, minlength=n_rows)
    bad |= per_row % 2 == 1
    keep = ~bad[q_row]
    quotes, q_row = quotes[keep], q_row[keep]
    opens, closes = quotes[::2], quotes[1::2]
    delta = np.zeros(n + 1, np.int8)
    delta[opens] = 1
    np.subtract.at(delta, closes + 1, 1)
    inside = np.cumsum(delta[:n], dtype=np.int8) > 0

    kinds = _CLASS[flat]
    odd[row_of[np.flatnonzero(inside & (flat < 32))]] = True
    kinds[inside] = 0
    odd[row_of[np.flatnonzero(kinds == _OTHER)]] = True
    scalar = kinds == _SCALAR
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = scalar.copy()
    starts[1:] &= ~scalar[:-1] | edge[1:n]
    ends = scalar.copy()
    ends[:-1] &= ~scalar[1:] | edge[1:n]
    s_start, s_end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    marks = np.flatnonzero((kinds >= 1) & (kinds <= 6))

    # tokens in order
    at = np.concatenate([marks, opens, s_start])
    kind = np.concatenate([kinds[marks].astype(np.int64), np.full(len(opens), STRING), np.full(len(s_start), NUMBER)])
    start = np.concatenate([marks, opens + 1, s_start])
    end = np.concatenate([marks + 1, closes, s_end])
    order = np.argsort(at, kind="stable")
    at, kind, start, end = at[order], kind[order], start[order], end[order]
    row = row_of[at]

    # depth by prefix sums; payloads that don't close are unreadable
    def depths(kind: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        step = np.where((kind == OBJECT) | (kind == ARRAY), 1, np.where((kind == _CLOSE_OBJECT) | (kind == _CLOSE_ARRAY), -1, 0))
        total = np.cumsum(step)
        head = np.searchsorted(row, np.arange(n_rows + 1))
        base = np.concatenate([[0], total])[head[:-1]]
        return step, total - base[row], head

    step, depth, head = depths(kind, row)
    some = np.flatnonzero(np.diff(head))
    bad[np.flatnonzero(np.diff(head) == 0)] = True
    if len(some):
        bad[some] |= np.minimum.reduceat(depth, head[some]) < 0
        bad[some] |= depth[head[some + 1] - 1] != 0
    keep = ~(bad | odd)[row]
    kind, start, end, row = kind[keep], start[keep], end[keep], row[keep]
    step, depth, head = depths(kind, row)
    m = len(kind)

    # the container of each token: the last opening bracket one level up
    level = depth - (step == 1)
    looks = np.where(step == -1, level + 1, level)
    opening = np.flatnonzero(step == 1)
    who = np.concatenate([np.arange(m), opening])
    lev = np.concatenate([looks, level[opening] + 1])
    is_open = np.concatenate([np.zeros(m, bool), np.ones(len(opening), bool)])
    order = np.lexsort((is_open, who, lev))
    filled = np.maximum.accumulate(np.where(is_open[order], np.arange(len(order)), -1)) if len(order) else order
    container = np.full(m, -1)
    told = ~is_open[order]
    container[who[order][told]] = np.where(filled[told] >= 0, who[order][np.maximum(filled[told], 0)], -1)
    container[looks == 0] = -1
    inside_kind = np.where(container >= 0, kind[container], 0)
    wrong = ((kind == _CLOSE_OBJECT) & (inside_kind != OBJECT)) | ((kind == _CLOSE_ARRAY) & (inside_kind != ARRAY))
    bad[row[wrong]] = True

    # grammar: what may follow what
    is_head = np.zeros(m + 1, bool)
    is_head[head[:-1]] = True
    is_head = is_head[:m]
    prev = np.where(is_head, 0, np.concatenate([[0], kind[:-1]])[:m])
    item = np.isin(kind, (OBJECT, ARRAY, STRING, NUMBER))
    key_place = (inside_kind == OBJECT) & ((prev == OBJECT) | (prev == _COMMA))
    is_key = (kind == STRING) & key_place
    prev_key = np.concatenate([[False], is_key[:-1]])[:m] & ~is_head
    value = item & ~is_key
    value_ok = ((prev == 0) & (level == 0)) | (prev == _COLON) | (prev == ARRAY) | ((prev == _COMMA) & (inside_kind == ARRAY))
    ended = (prev == _CLOSE_OBJECT) | (prev == _CLOSE_ARRAY) | (((prev == STRING) | (prev == NUMBER)) & ~prev_key)
    ok = is_key | (value & value_ok) | ((kind == _COLON) & prev_key) | ((kind == _COMMA) & ended & (container >= 0))
    ok |= (step == -1) & (ended | ((kind == _CLOSE_OBJECT) & (prev == OBJECT)) | ((kind == _CLOSE_ARRAY) & (prev == ARRAY)))
    odd[row[~ok]] = True

    # scalars: numbers and the words of JSON or of Python
    words = np.flatnonzero(kind == NUMBER)
    lead = flat[start[words]]
    number = ((lead >= 48) & (lead <= 57)) | (lead == 45)
    size = end[words] - start[words]
    leading_zero = (lead == 48) & (size > 1)
    leading_zero &= np.isin(flat[np.minimum(start[words] + 1, n - 1)], np.arange(48, 58))
    odd[row[words[leading_zero]]] = True
    json_word, py_word = np.zeros(n_rows, bool), np.zeros(n_rows, bool)
    known = number.copy()
    for word, to, flags in ((b"null", NULL, json_word), (b"true", BOOL, json_word), (b"false", BOOL, json_word), (b"None", NULL, py_word), (b"True", BOOL, py_word), (b"False", BOOL, py_word)):
        hit = np.flatnonzero(~number & (size == len(word)))
        for k, byte in enumerate(word):
            hit = hit[flat[start[words[hit]] + k] == byte]
        kind[words[hit]] = to
        flags[row[words[hit]]] = True
        known[hit] = True
    odd[row[words[~known]]] = True
    numeric = words[number]
    if len(numeric):
        inner = _ranges(start[numeric], end[numeric] - start[numeric])
        whole = np.isin(flat[inner], np.frombuffer(b"0123456789.-", np.uint8))
        owner = np.repeat(np.arange(len(numeric)), end[numeric] - start[numeric])
        strange = np.unique(owner[~whole])
        dots = np.bincount(owner[flat[inner] == 46], minlength=len(numeric))
        minus = np.bincount(owner[flat[inner] == 45], minlength=len(numeric)) - (flat[start[numeric]] == 45)
        last_dot = flat[end[numeric] - 1]
        for k in np.union1d(strange, np.flatnonzero((dots > 1) | (minus > 0) | (last_dot == 46) | (last_dot == 45))):
            odd[row[numeric[k]]] = True
    single = np.zeros(n_rows, bool)
    single[q_row[flat[quotes] == 39]] = True
    odd |= json_word & (py_word | single)

    # keys
    key_at = np.flatnonzero(is_key)
    key_id = np.full(m, -1)
    k_start, k_size = start[key_at], end[key_at] - start[key_at]
    for name, number_of in _ID.items():
        hit = np.flatnonzero(k_size == len(name))
        for k, byte in enumerate(name.encode()):
            hit = hit[flat[k_start[hit] + k] == byte]
        key_id[key_at[hit]] = number_of
    if len(key_at) and not plain:
        with_slash = np.concatenate([[0], np.cumsum(slash)])
        odd[row[key_at[with_slash[end[key_at]] > with_slash[start[key_at]]]]] = True

    values = np.flatnonzero(value)
    under = np.where((prev[values] == _COLON) & (values >= 2), key_id[np.maximum(values - 2, 0)], -1)
    named = values[under >= 0]
    keyed = container[named] * len(FIELDS) + under[under >= 0]
    order = np.argsort(keyed, kind="stable")
    in_array = values[inside_kind[values] == ARRAY]
    by = np.argsort(container[in_array], kind="stable")
    child = in_array[by]
    first = np.searchsorted(container[child], np.arange(m + 1))
    root = np.full(n_rows, -1)
    top = values[container[values] == -1]
    root[row[top]] = top
    root[bad | odd] = -1
    kind = np.where(value, kind, 0)
    return Index(flat, kind, row, start, end, root, odd & ~bad, keyed[order], named[order], child, first)


@dataclass
class Entries:
    """Tokens or blocks of payloads: valid ones only, in order of appearance, numbered by row."""

    row: np.ndarray
    page: np.ndarray
    start: np.ndarray
    end: np.ndarray
    box: np.ndarray  # n x 4
    node: np.ndarray

    def number(self) -> np.ndarray:
        head = np.searchsorted(self.row, self.row)
        return np.arange(len(self.row)) - head


def _entries(ix: Index, node: np.ndarray, page: np.ndarray, start: np.ndarray, end: np.ndarray, box: np.ndarray, order: tuple = ()) -> Entries:
    whole = (start == np.floor(start)) & (end == np.floor(end)) & ~np.isnan(box).any(axis=1)  # NaN isn't equal to itself
    node, page, start, end, box = node[whole], page[whole], start[whole], end[whole], box[whole]
    sort = np.lexsort((node, *(o[whole] for o in order), ix.row[node]))
    node = node[sort]
    return Entries(ix.row[node], page[sort].astype(np.int64), start[sort].astype(np.int64), end[sort].astype(np.int64), box[sort], node)


def _whole_or(values: np.ndarray, default: np.ndarray | int) -> np.ndarray:
    return np.where(values == np.floor(values), values, default)


def _offsets(ix: Index, at: np.ndarray, names: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    doc = ix.only(ix.first_of(at, names or ["doc_offset"]), OBJECT)
    return ix.numbers(ix.get(doc, "start")), ix.numbers(ix.get(doc, "end"))


def _unit_entries(ix: Index, units: np.ndarray, field: str) -> Entries:
    _, at, _ = ix.elements(ix.get(units, field))
    at = at[ix.kind[at] == OBJECT]
    position = ix.only(ix.get(at, "position"), OBJECT)
    box = np.stack([ix.numbers(ix.first_of(position, names)) for names in SIDES], axis=1)
    page = _whole_or(ix.numbers(ix.get(at, "page_num")), 0)
    return _entries(ix, at, page, *_offsets(ix, at), box)


def _form_pages(ix: Index, forms: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(page object, its page_no) of form payloads. ``wide``: under any of the names that deliveries use; one that isn't a whole number is passed over."""
    _, at, place = ix.elements(ix.get(forms, "pages"))
    keep = ix.kind[at] == OBJECT
    at, place = at[keep], place[keep]
    if not wide:
        return at, _whole_or(ix.numbers(ix.first_of(at, ["page_id", "page_num"])), place)
    number = place.astype(np.float64)
    for name in ("page_index", "pageNumber", "page", "page_num", "page_id"):
        number = _whole_or(ix.numbers(ix.get(at, name)), number)
    return at, number


def _wide_box(ix: Index, at: np.ndarray) -> np.ndarray:
    """Boxes under any of their names: a list of four sides, or of five after the page, or an object with sides or with a size."""
    value = ix.first_of(at, ["bbox", "position", "bounding_box", "boundingBox"])
    n = ix.count(value)
    listed = np.stack([np.where(n == 5, ix.numbers(ix.element(value, k + 1)), ix.numbers(ix.element(value, k))) for k in range(4)], axis=1)
    named = ix.only(value, OBJECT)
    number = lambda *names: ix.numbers(ix.first_of(named, list(names)))
    left, top, right, bottom = number("left", "x0", "x"), number("top", "y0", "y"), number("right", "x1"), number("bottom", "y1")
    right = np.where(np.isnan(right), left + number("width"), right)
    bottom = np.where(np.isnan(bottom), top + number("height"), bottom)
    return np.where((named >= 0)[:, None], np.stack([left, top, right, bottom], axis=1), np.where((n >= 4)[:, None], listed, np.nan))


def _form_entries(ix: Index, pages: np.ndarray, page_no: np.ndarray, fields: list[str], wide: bool = False) -> Entries:
    parts = []
    for k, field in enumerate(fields):
        owner, at, _ = ix.elements(ix.get(pages, field))
        keep = ix.kind[at] == OBJECT
        parts.append((at[keep], owner[keep], np.full(int(keep.sum()), k)))
    at, owner, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
    pair = ix.element(ix.get(at, "segments"), 0)
    pair = np.where(ix.count(pair) == 2, pair, -1)
    alone = ix.get(at, "segment")
    pair = np.where(pair >= 0, pair, np.where(ix.count(alone) == 2, alone, -1))
    from_doc = _offsets(ix, at, ["doc_offset", "text_offset", "offset"] if wide else ["doc_offset"])
    start, end = (np.where(pair >= 0, ix.numbers(ix.element(pair, k)), from_doc[k]) for k in (0, 1))
    bbox = ix.get(at, "bbox")
    n = ix.count(bbox)
    sides = [[ix.numbers(ix.element(bbox, k + s)) for s in (0, 1)] for k in range(4)]
    box = _wide_box(ix, at) if wide else np.stack([np.where((n == 4) | (n == 5), np.where(n == 5, five, four), np.nan) for four, five in sides], axis=1)
    page = page_no[owner] if len(owner) else np.zeros(0)
    return _entries(ix, at, page, start, end, box, (rank, pages[owner] if len(owner) else owner))


def _box_entries(ix: Index, payloads: np.ndarray) -> Entries:
    _, at, _ = ix.elements(ix.get(payloads, "ocr_boxes"))
    at = at[ix.kind[at] == OBJECT]
    points = ix.get(at, "points")
    at, points = at[ix.count(points) >= 4], points[ix.count(points) >= 4]
    text = ix.texts(ix.get(at, "text"))
    shown = pc.greater(pc.binary_length(pc.utf8_trim_whitespace(ix.strings(text))), 0).fill_null(False).to_numpy(zero_copy_only=False)
    at, points = at[shown], points[shown]
    owner, point, _ = ix.elements(points)
    box = np.full((len(at), 4), np.nan)
    if len(owner):
        head = np.searchsorted(owner, np.arange(len(at)))
        for k in (0, 1):
            values = ix.numbers(ix.element(point, k))
            box[:, k], box[:, k + 2] = np.fmin.reduceat(values, head), np.fmax.reduceat(values, head)
    row = ix.row[at]
    zero = np.zeros(len(at), np.int64)
    return Entries(row, zero, zero, zero, box, at)


def _enclosing(tokens: Entries, blocks: Entries) -> np.ndarray:
    """The lowest-numbered block of each token's page whose range encloses the token's, else -1.

    Blocks are sorted by page and begin, so those of a page that begin early enough are one stretch. Stretches are
    covered by blocks' groups of 1, 2, 4 ... neighbours, two groups of each size at most; a group sorted by end, with the
    least number from each place on, gives its answer by binary search. Each size is done for all tokens at once.
    """
    out = np.full(len(tokens.row), -1)
    n = len(blocks.row)
    if not n or not len(out):
        return out
    number = blocks.number()
    # row and page as one number, ends as ranks
    _, page = np.unique(np.concatenate([blocks.page, tokens.page]), return_inverse=True)
    width = int(page.max()) + 1
    b_key, t_key = blocks.row * width + page[:n], tokens.row * width + page[n:]
    order = np.lexsort((blocks.start, b_key))
    b_key, b_start, b_end, number = b_key[order], blocks.start[order], blocks.end[order], number[order]
    ends = np.unique(b_end)
    rank, t_rank = np.searchsorted(ends, b_end), np.searchsorted(ends, tokens.end)
    lo = np.searchsorted(b_key, t_key, "left")
    # places of (page, begin) pairs: tokens are sorted in among the blocks, after those that begin where they do
    both = np.lexsort((np.append(np.zeros(n), np.ones(len(out))), np.append(b_start, tokens.start), np.append(b_key, t_key)))
    hi = np.empty(len(out), np.int64)
    is_token = both >= n
    hi[both[is_token] - n] = np.cumsum(~is_token)[is_token]
    never = np.iinfo(np.int64).max
    best = np.full(len(out), never)
    size, place = len(ends) + 1, np.arange(n)
    while (open_ := np.flatnonzero(lo < hi)).size:
        # groups of this size, sorted by end; the least number of those that end no earlier
        by_end = np.lexsort((rank, place))
        key = place[by_end] * size + rank[by_end]
        last = np.append(place[by_end][1:] != place[by_end][:-1], True)
        least = _least_to_group_end(number[by_end], last)
        for at, side in ((open_[lo[open_] % 2 == 1], lo), (open_[hi[open_] % 2 == 1], hi - 1)):
            group = side[at]
            found = np.searchsorted(key, group * size + t_rank[at])
            ok = (found < n) & (place[by_end[np.minimum(found, n - 1)]] == group)
            best[at[ok]] = np.minimum(best[at[ok]], least[found[ok]])
        lo, hi = (lo + 1) // 2, hi // 2
        place = place // 2
    return np.where(best < never, best, -1)


def _least_to_group_end(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of each value and those after it up to the end of its group."""
    # groups get falling offsets, so that a running minimum from the back never reaches over a border
    group = np.cumsum(last[::-1]) * (int(values.max()) + 1)
    back = values[::-1] - group
    return (np.minimum.accumulate(back) + group)[::-1]


@dataclass
class Shredded:
    """The three tables of a chunk; ``node`` of entries refers to ``index``."""

    index: Index
    tokens: Entries
    block_of: np.ndarray
    blocks: Entries
    pages: list[np.ndarray]  # row, page_no, width, height, and the page's object or -1


def _join(parts: list[Entries]) -> tuple[Entries, np.ndarray]:
    """Entries of several shapes in order of rows, and where each came from."""
    fields = [np.concatenate([getattr(p, f) for p in parts]) for f in ("row", "page", "start", "end", "box", "node")]
    order = np.argsort(fields[0], kind="stable")
    return Entries(*(f[order] for f in fields)), order


def shred_chunk(flat: np.ndarray, offs: np.ndarray, plain: bool = False, wide: bool = False) -> Shredded:
    ix = structural_index(flat, offs, plain)
    root = ix.root[ix.root >= 0]
    lists = root[ix.kind[root] == ARRAY]
    objects = root[ix.kind[root] == OBJECT]
    boxed = ix.get(objects, "ocr_boxes") >= 0
    unit = ~boxed & ((ix.get(objects, "tokens") >= 0) | (ix.get(objects, "blocks") >= 0))
    form = objects[~boxed & ~unit]
    _, inner, _ = ix.elements(lists)
    units = np.concatenate([objects[unit], inner[ix.kind[inner] == OBJECT]])
    pages, page_no = _form_pages(ix, form, wide)
    boxes = _box_entries(ix, objects[boxed])
    tokens, order = _join([_unit_entries(ix, units, "tokens"), _form_entries(ix, pages, page_no, ["tokens"], wide), boxes])
    blocks, _ = _join([_unit_entries(ix, units, "blocks"), _form_entries(ix, pages, page_no, ["lines", "paragraphs"], wide), boxes])
    block_of = _enclosing(tokens, blocks)
    of_box = order >= len(order) - len(boxes.row)
    block_of[of_box] = tokens.number()[of_box]
    return Shredded(ix, tokens, block_of, blocks, _pages(ix, units, pages, page_no, boxes, wide))


def _pages(ix: Index, units: np.ndarray, pages: np.ndarray, page_no: np.ndarray, boxes: Entries, wide: bool = False) -> list[np.ndarray]:
    """row, page_no, width and height of the pages that payloads list; a box payload has one page around its boxes."""
    _, at, place = ix.elements(ix.get(units, "pages"))
    keep = ix.kind[at] == OBJECT
    at, place = at[keep], place[keep]
    parts = [(ix.row[at], _whole_or(ix.numbers(ix.get(at, "page_num")), place), *(ix.numbers(ix.get(ix.only(ix.get(at, "size"), OBJECT), d)) for d in ("width", "height")), at)]
    size = ix.only(ix.first_of(pages, ["dimension", "dimensions", "size"]) if wide else ix.get(pages, "dimension"), OBJECT)
    sides = [ix.numbers(ix.get(size, d)) for d in ("width", "height")]
    if wide:  # a side of 0 is none, the page's own come next
        for k, d in enumerate(("width", "height")):
            for own in (d, f"page_{d}"):
                sides[k] = np.where(np.nan_to_num(sides[k]) != 0, sides[k], ix.numbers(ix.get(pages, own)))
    parts.append((ix.row[pages], page_no, *sides, pages))
    rows, head = np.unique(boxes.row, return_index=True)
    if len(rows):
        parts.append((rows, np.zeros(len(rows)), *(np.fmax.reduceat(boxes.box[:, k], head) for k in (2, 3)), np.full(len(rows), -1)))
    row, no, width, height, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return [row[order], no[order].astype(np.int64), width[order], height[order], node[order]]


def _payload_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def _plain(value: object) -> object:
    """A parsed payload as JSON can hold it: tuples as lists, numbers without end as null, keys as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not np.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float)) else None


def _readable(text: str) -> str | None:
    """An odd payload as JSON, None if it is neither JSON nor a Python literal."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        for read in (json.loads, lambda t: ast.literal_eval(t.strip())):
            try:
                return json.dumps(_plain(read(text)), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
    return None


def _parts(batches: Iterator[pa.RecordBatch], wide: bool = False) -> Iterator[tuple[pa.Array, Shredded]]:
    """(raw_id column, tables) of chunks; odd payloads are made plain JSON and indexed again."""
    for batch in batches:
        ids, texts = batch.columns
        if texts.type != pa.string():
            texts = texts.cast(pa.string())
        _, offs = _payload_bytes(texts)
        lo = 0
        while lo < len(texts):
            hi = min(len(texts), max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1))
            part, part_ids = texts.slice(lo, hi - lo), ids.slice(lo, hi - lo)
            made = shred_chunk(*_payload_bytes(part), wide=wide)
            yield part_ids, made
            again = np.flatnonzero(made.index.odd)
            if len(again):
                fixed = [(k, t) for k in again.tolist() if (t := _readable(part[k].as_py())) is not None]
                if fixed:
                    rows = pa.array([k for k, _ in fixed])
                    yield part_ids.take(rows), shred_chunk(*_payload_bytes(pa.array([t for _, t in fixed], pa.string())), plain=True, wide=wide)
            lo = hi


def _rows(ids: pa.Array, row: np.ndarray, names: list[str], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in columns]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *arrays], ["raw_id", *names])


def _payloads(exports: DataFrame) -> DataFrame:
    payload = F.coalesce("ocr_json", "ocr_output", "ocr_data")
    return exports.select("raw_id", payload.alias("payload")).where("payload is not null")


def token_links(exports: DataFrame) -> DataFrame:
    """(raw_id, tok_no, page_no, block_id): a row for each valid token, linked to its page and block (-1: none).

    The payload is the first of ocr_json, ocr_output, ocr_data that isn't null; unreadable, cut off and empty ones
    give no rows. A payload with ocr_boxes is a box payload, one with tokens or blocks (or a list) a unit
    payload, any other with pages a form payload. Null raw_ids are kept; repeated rows give repeated rows;
    other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _parts(batches):
            t = made.tokens
            yield _rows(ids, t.row, ["tok_no", "page_no", "block_id"], [t.number(), t.page, made.block_of])

    return map_arrow(_payloads(exports), run, _schema(exports, "tok_no bigint, page_no bigint, block_id bigint"))


def _schema(exports: DataFrame, rest: str) -> str:
    return f"raw_id {exports.schema['raw_id'].dataType.simpleString()}, {rest}"


def token_table(exports: DataFrame, wide: bool = False) -> DataFrame:
    """token_links with text, range and box; a box entry has no range. Text is null where it is neither a string nor a number.
    ``wide``: pages, ranges and boxes of form payloads may have any of the names that deliveries use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _parts(batches, wide):
            t = made.tokens
            yield _rows(ids, t.row, ["tok_no", "page_no", "block_id", *_ENTRY], [t.number(), t.page, made.block_of, *_entry_columns(made.index, t)])

    return map_arrow(_payloads(exports), run, _schema(exports, f"tok_no bigint, page_no bigint, block_id bigint, {_ENTRY_SCHEMA}"))


_ENTRY = ["text", "char_start", "char_end", "x0", "y0", "x1", "y1"]
_ENTRY_SCHEMA = "text string, char_start bigint, char_end bigint, x0 double, y0 double, x1 double, y1 double"


def _entry_columns(ix: Index, e: Entries) -> list:
    at = ix.texts(ix.get(e.node, "text"))
    return [ix.strings(at), e.start, e.end, *(e.box[:, k] for k in range(4))]


def block_table(exports: DataFrame, wide: bool = False) -> DataFrame:
    """(raw_id, block_id, page_no, text, range, box): a row for each valid block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _parts(batches, wide):
            b = made.blocks
            yield _rows(ids, b.row, ["block_id", "page_no", *_ENTRY], [b.number(), b.page, *_entry_columns(made.index, b)])

    return map_arrow(_payloads(exports), run, _schema(exports, f"block_id bigint, page_no bigint, {_ENTRY_SCHEMA}"))


def page_table(exports: DataFrame, wide: bool = False) -> DataFrame:
    """(raw_id, page_no, page_width, page_height, text): a row for each page that a payload lists; sizes and text may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _parts(batches, wide):
            row, no, width, height, node = made.pages
            at = made.index.only(made.index.get(node, "text"), STRING)
            yield _rows(ids, row, ["page_no", "page_width", "page_height", "text"], [no, width, height, made.index.strings(at)])

    return map_arrow(_payloads(exports), run, _schema(exports, "page_no bigint, page_width double, page_height double, text string"))


def payload_table(exports: DataFrame, wide: bool = False) -> DataFrame:
    """(raw_id, shape, text, n_pages, n_tokens, n_blocks): a row for each readable payload, object or list: unit, form, box or other, its own text if it
    has one, and how many pages it lists and valid tokens and blocks it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made in _parts(batches, wide):
            ix, n = made.index, len(ids)
            row = np.flatnonzero((ix.root >= 0) & np.isin(ix.kind[ix.root], (OBJECT, ARRAY))) if len(ix.kind) else np.zeros(0, np.int64)
            root = ix.root[row]
            have = lambda name: ix.get(ix.only(root, OBJECT), name) >= 0
            unit = (ix.kind[root] == ARRAY) | have("tokens") | have("blocks")
            shape = np.where(have("ocr_boxes"), "box", np.where(unit, "unit", np.where(have("pages"), "form", "other")))
            counts = [np.bincount(x, minlength=n)[row] for x in (made.pages[0], made.tokens.row, made.blocks.row)]
            yield _rows(ids, row, ["shape", "text", "n_pages", "n_tokens", "n_blocks"], [pa.array(shape.tolist(), pa.string()), ix.strings(ix.only(ix.get(ix.only(root, OBJECT), "text"), STRING)), *counts])

    return map_arrow(_payloads(exports), run, _schema(exports, "shape string, text string, n_pages bigint, n_tokens bigint, n_blocks bigint"))
