"""One consistent form for text that looks the same, over arrays of code points.

What is made one: width and joined forms of letters, digits and signs; accents as marks of their own or
as part of the letter; characters that show nothing; no-break blanks; Cyrillic and Greek letters drawn
like a Latin one. Everything else stays: other letters, case, punctuation, the number of blanks and line breaks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.columns import characters, chunks, code_points, span_hashes, string_array, strings
from folia.llm.filters import filter_of, passing
from folia.session import cut_lineage, map_arrow

# Letters of one case drawn like a Latin letter of that case, each above the Latin letter. Those that are only near to one
# (У and Y, г and r, Ь and b, ѡ and w, ҽ and e; γ and y, σ and o, η and n, ω and w) are other letters to a reader and stay.
CYRILLIC = "АВЕЅІӀЈКМНОРСТѴХҮԌԚԜаеһіӏјорԛѕсѵԝхуүԁ"
CYR_LATIN = "ABESIIJKMHOPCTVXYGQWaehiljopqscvwxyyd"
GREEK = "ΑΒϹΕϜΗΙͿΚΜϺΝΟΡΤΧΥΖαϲιϳονρυ"
GRE_LATIN = "ABCEFHIJKMMNOPTXYZacijovpu"
# Blanks that differ from U+0020 in not breaking the line only.
NO_BREAK = [0xA0, 0x2007, 0x202F]
# Forms of compatibility decompositions that leave the looks, but for width, joining or design.
SAME_LOOK = ["<wide>", "<narrow>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<square>", "<font>", "<noBreak>"]
# Control characters that show as blanks or line breaks, and format characters that show.
BREAKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]
SHOWN_FORMATS = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]
# Further characters that show nothing (fillers, joiners and variation selectors), as ranges.
NOTHING = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]

_S, _L, _V, _T, _NV, _NT = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
_HANGUL = (0xAC00, 0xD7A3)


@dataclass
class Tables:
    size: np.ndarray  # code point -> length of what it becomes: 0 dropped, 1 mostly
    first: np.ndarray  # code point -> what it becomes, where size is 1; else the place in ``longer``
    longer: np.ndarray
    mark: np.ndarray  # code point -> canonical combining class
    second: np.ndarray  # code point -> whether it can join the letter before it
    pairs: np.ndarray  # sorted letter << 21 | mark
    composed: np.ndarray
    busy: np.ndarray  # code point -> whether it changes or can join
    blank: np.ndarray  # code point -> whether it shows as blank


_TABLES: list[Tables] = []


def _expand(ch: str, seen: dict[str, str]) -> str:
    """What a character becomes: its parts, as far as they look the same, with Latin letters for letters like them."""
    if ch not in seen:
        parts = unicodedata.decomposition(ch).split()
        tag = parts.pop(0) if parts and parts[0][0] == "<" else ""
        text = "".join(chr(int(p, 16)) for p in parts)
        keep = not parts or (tag and (tag not in SAME_LOOK or (tag == "<compat>" and text[0] == " ")))
        seen[ch] = ch if keep else "".join(_expand(c, seen) for c in text)
    return seen[ch]


def tables() -> Tables:
    """The lookup tables, made from the Unicode data of Python once in a process."""
    if _TABLES:
        return _TABLES[0]
    top = sys.maxunicode + 1
    like = dict(zip(CYRILLIC + GREEK, CYR_LATIN + GRE_LATIN, strict=True))
    blank = np.zeros(top, bool)
    size, first = np.ones(top, np.int8), np.arange(top, dtype=np.uint32)
    mark, second = np.zeros(top, np.uint8), np.zeros(top, bool)
    longer: list[int] = []
    pairs: dict[int, int] = {}
    seen = dict(like)
    for cp in characters():
        ch = chr(cp)
        kind = unicodedata.category(ch)
        blank[cp] = ch.isspace()
        if kind == "Mn" or kind == "Mc" or kind == "Me":
            mark[cp] = unicodedata.combining(ch)
        if (kind == "Cf" and cp not in SHOWN_FORMATS) or (kind == "Cc" and cp not in BREAKS):
            size[cp] = 0
            continue
        parts = unicodedata.decomposition(ch)
        if not parts and ch not in like:
            continue
        if parts and parts[0] != "<":
            two = parts.split()
            if len(two) == 2 and unicodedata.is_normalized("NFC", ch):
                pairs[int(two[0], 16) << 21 | int(two[1], 16)] = cp
                second[int(two[1], 16)] = True
        text = _expand(ch, seen)
        if len(text) == 1:
            first[cp] = ord(text)
        else:
            size[cp], first[cp] = len(text), len(longer)
            longer.extend(map(ord, text))
    for lo, hi in NOTHING:
        size[lo : hi + 1] = 0
    for cp in NO_BREAK:
        size[cp], first[cp] = 1, 0x20
    # letters whose parts were Latin look-alikes join as the Latin letter does, so the pairs need no look-alikes
    second[_V : _V + _NV] = second[_T + 1 : _T + _NT] = True
    keys = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(keys)
    busy = (size != 1) | (first != np.arange(top)) | (mark > 0) | second
    _TABLES.append(Tables(size, first, np.array(longer, np.uint32), mark, second, keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order], busy, blank))
    return _TABLES[0]


def _compose_pair(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The letter that a and b make together, -1 if none."""
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    out = np.where(t.pairs[at] == key, t.composed[at], -1)
    a, b = a.astype(np.int64), b.astype(np.int64)
    lv = (a >= _L) & (a < _L + 19) & (b >= _V) & (b < _V + _NV)
    out = np.where(lv, _S + ((a - _L) * _NV + (b - _V)) * _NT, out)
    lvt = (a >= _HANGUL[0]) & (a <= _HANGUL[1]) & ((a - _S) % _NT == 0) & (b > _T) & (b < _T + _NT)
    return np.where(lvt, a + (b - _T), out)


def consistent(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts points[offs[k]:offs[k + 1]] in the consistent form, in the same layout.

    Lookup-table gathers with expansion offsets, then marks are put in canonical order and joined to
    their letters, each step for all texts at once.
    """
    t = tables()
    if not t.busy[points].any():
        return points, offs
    # expand
    size = t.size[points]
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    out = np.empty(ends[-1], np.uint32)
    one = size == 1
    out[ends[:-1][one]] = t.first[points[one]]
    many = np.flatnonzero(size > 1)
    if len(many):
        count = size[many].astype(np.int64)
        into = np.repeat(ends[many] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out[into] = t.longer[np.repeat(t.first[points[many]].astype(np.int64) - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    offs = ends[offs]
    points = out
    touching = np.flatnonzero(t.second[points] | (t.mark[points] > 0))
    if not len(touching):
        return points, offs
    return _compose(t, points, offs, touching)


def _compose(t: Tables, points: np.ndarray, offs: np.ndarray, touching: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    points = points.copy()
    head = np.zeros(n + 1, bool)
    head[offs[:-1]] = True
    # canonical order of runs of marks: a stable sort by class within each run
    mark = t.mark[points[touching]]
    runs = np.flatnonzero(mark > 0)
    if len(runs):
        at, cls = touching[runs], mark[runs]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | head[at[1:]]
        if (~fresh).any() and (cls[1:] < cls[:-1])[~fresh[1:]].any():
            order = np.lexsort((cls, np.cumsum(fresh)))
            points[at] = points[at[order]]
    # join: the first free mark of each letter, again and again
    gone = np.zeros(n, bool)
    queue = touching
    mark = t.mark[points[queue]]
    # the letter before: the last place of class 0; marks at a text's begin have none
    owner = np.where(t.mark[points] == 0, np.arange(n), -1)
    owner = np.maximum.accumulate(owner)
    prev_owner = np.where(queue > 0, owner[np.maximum(queue - 1, 0)], -1)
    text_of = np.searchsorted(offs, queue, "right") - 1
    prev_owner = np.where(prev_owner >= offs[text_of], prev_owner, -1)
    keep = prev_owner >= 0
    queue, mark, own = queue[keep], mark[keep].astype(np.int64), prev_owner[keep]
    # a starter that joins its letter makes that letter the owner of what follows it (Hangul and the like)
    while len(queue):
        # what stands between it and its letter still: the one before it in the queue, if it has the same letter
        before = np.full(len(queue), -1, np.int64)
        same = own[1:] == own[:-1]
        before[1:][same] = mark[:-1][same]
        free = (before < 0) | ((before > 0) & (before < mark))
        made = np.where(free, _compose_pair(t, points[own], points[queue]), -1)
        can = np.flatnonzero(made >= 0)
        if not len(can):
            break
        lead = np.ones(len(can), bool)
        lead[1:] = own[can[1:]] != own[can[:-1]]
        can = can[lead]
        points[own[can]] = made[can]
        gone[queue[can]] = True
        joined = queue[can][mark[can] == 0]
        if len(joined):
            target = own[can][mark[can] == 0]
            at = np.searchsorted(joined, own)
            at = np.minimum(at, len(joined) - 1)
            hit = joined[at] == own
            own = np.where(hit, target[at], own)
        left = np.ones(len(queue), bool)
        left[can] = False
        queue, mark, own = queue[left], mark[left], own[left]
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(~gone, out=ends[1:])
    return points[~gone], ends[offs]


def consistent_text(text: str) -> str:
    """The form of one text; for tests and single values."""
    points, offs, _ = code_points(pa.array([text], pa.string()))
    return strings(*consistent(points, offs))[0].as_py()


def consistent_form(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): each text in the consistent form. Null stays null, empty stays empty, rows that repeat
    repeat, an empty table gives an empty one; other columns are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_array(batch.column(1))
            null = batch.column(1).is_null()
            for lo, hi in chunks(texts):
                points, offs, _ = code_points(texts.slice(lo, hi - lo))
                made = strings(*consistent(points, offs))
                if null.slice(lo, hi - lo).true_count:
                    made = pc.if_else(null.slice(lo, hi - lo), pa.scalar(None, pa.string()), made)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), made], ["id", "form"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, form string").toDF(id_col, text_col)


def _two_hashes(points: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """128 bits for each text, from its code points."""
    return [span_hashes(points.astype(np.uint64), offs[:-1], offs[1:], salt).view(np.int64) for salt in (1, 0x2545F4914F6CDD1D)]


def form_digests(docs: DataFrame, with_form: bool = False) -> DataFrame:
    """docs (id, text) -> (id, f1, f2, e1, e2): 128-bit digests of each text's consistent form and of the text itself, hashed as code
    points, and the form if it is asked for; texts of nothing but blanks, or of characters that show nothing, are left out."""
    names = ["id", "f1", "f2", "e1", "e2", "shown"][: 5 + with_form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_array(batch.column(1))
            for lo, hi in chunks(texts):
                points, offs, _ = code_points(texts.slice(lo, hi - lo))
                form, ends = consistent(points, offs)
                visible = np.zeros(len(form) + 1, np.int64)
                np.cumsum(~tables().blank[form], out=visible[1:])
                keep = pa.array(np.flatnonzero(visible[ends[1:]] > visible[ends[:-1]]))
                exact = _two_hashes(points, offs)
                columns = [pa.array(x) for x in (*(exact if form is points else _two_hashes(form, ends)), *exact)]
                columns = [batch.column(0).slice(lo, hi - lo), *columns, *([strings(form, ends)] if with_form else [])]
                yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], names)

    return map_arrow(docs, run, "id bigint, f1 bigint, f2 bigint, e1 bigint, e2 bigint" + (", shown string" if with_form else ""))


class Lookalikes:
    """Documents whose texts differ but have the same consistent form.

    The corpus is scanned once for digests, which are written. Equal texts are one class; only forms with two classes
    or more go on, and the forms of a text of each of those classes are compared as such, so that no pair rests on a hash of
    forms. A text that a third of all rows share is one class and is never compared with itself. Texts that
    differ are told apart by 128 bits.

    Null ids and null, empty or blank texts are in no class; rows that repeat with id and text count once; an
    empty table gives empty results; other columns are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        form, exact = F.struct("f1", "f2").alias("form"), F.struct("e1", "e2").alias("exact")
        rows = cut_lineage(form_digests(docs)).select("id", form, exact)
        several = rows.groupBy("form").agg(F.min("exact").alias("least"), F.max("exact").alias("most")).where("least <> most").select("form")
        classes = cut_lineage(rows.join(several, "form", "left_semi").groupBy("form", "exact").agg(F.min("id").alias("class_id")))
        some = passing(docs, "id", filter_of(classes.select("class_id"), classes.count()))
        shown = form_digests(some, with_form=True).select(F.col("id").alias("class_id"), form, exact, "shown").distinct()
        each = classes.join(shown, ["class_id", "form", "exact"])
        same = each.groupBy("form", "shown").agg(F.min("class_id").alias("form_id"))
        self.classes = cut_lineage(each.join(same, ["form", "shown"]).select("form", "form_id", "exact", "class_id"))
        self.members = rows.join(self.classes, ["form", "exact"]).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: every two documents of one form whose texts differ."""
        sides = [self.classes.select("form", "form_id", F.col("exact").alias(side)) for side in "ab"]
        both = sides[0].join(sides[1], ["form", "form_id"]).where("a < b").select("form", "a", "b")
        for side in "ab":
            both = both.join(self.members.select("form", F.col("exact").alias(side), F.col("id").alias(f"id_{side}")), ["form", side])
        return both.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b")).distinct()

    def groups(self) -> DataFrame:
        """One row for each document that has a partner: (doc_id, form_id, class_id, n_links): the least document of its form and
        of those with the very same text, and how many documents it looks like without being equal. No pairs are made."""
        by_class = self.members.groupBy("form", "form_id", "exact").agg(F.count_distinct("id").alias("own"))
        by_form = by_class.groupBy("form", "form_id").agg(F.sum("own").alias("all"))
        size = by_class.join(by_form, ["form", "form_id"]).select("form", "exact", (F.col("all") - F.col("own")).alias("n_links"))
        return self.members.join(size, ["form", "exact"]).select(F.col("id").alias("doc_id"), "form_id", "class_id", "n_links")
