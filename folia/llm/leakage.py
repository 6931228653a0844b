"""Held-out passages that stand in corpus documents: MinHash containment search over windows of words, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import words as W
from folia.llm.columns import span_hashes
from folia.llm.filters import among, filter_of
from folia.llm.lookalike import consistent
from folia.session import cut_lineage, map_arrow

#: Words in a run that counts as a leak, and in the shingles whose least hash stands for a window of that many.
RUN, SHINGLE = 12, 5


@dataclass
class Chunk:
    """Words of a chunk of texts in the consistent form."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    def texts(self, places: np.ndarray, n: int) -> pa.Array:
        """The n words from each place, with one blank between."""
        whole = self.low.astype("<u4", copy=False).tobytes().decode("utf-32-le", "replace")
        starts, ends = self.starts.tolist(), self.ends.tolist()
        return pa.array([" ".join([whole[starts[j] : ends[j]] for j in range(k, k + n)]) for k in places.tolist()], pa.string())


def _words(points: np.ndarray, offs: np.ndarray) -> Chunk:
    points, offs = consistent(points, offs)
    low, starts, ends, rows = W.word_spans(points, offs, "alnum")
    return Chunk(low, starts, ends, rows, span_hashes(low.astype(np.uint64), starts, ends))


def _windows(chunk: Chunk, run: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, MinHash) of every window of ``run`` words: the least hash of the window's shingles."""
    count = np.maximum(np.diff(chunk.rows) - run + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(chunk.rows[:-1], count)
    if not len(place):
        return place, text, np.zeros(0, np.uint64)
    at = np.arange(len(chunk.hashes) - shingle + 1)
    least = span_hashes(chunk.hashes, at, at + shingle)
    width, need = 1, run - shingle + 1
    while width * 2 <= need:  # least of 2, 4, 8 ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    return place, text, least[place]


def item_windows(items: DataFrame, run: int = RUN, shingle: int = SHINGLE, containment: float = 0.0) -> DataFrame:
    """items (item_id, text) -> (item_id, part, asked, least, exact, words): every different window of every item, its MinHash and its
    words. Items of fewer than ``run`` words have none.

    ``part``: items are partitioned by their number of windows, 1, 2-3, 4-7 and so on; ``asked``: whether the window is in the
    item's sketch. Of n windows, a document that holds the part ``containment`` (one at least) holds one of any n - m + 1, where m
    is what that part comes to for the smallest items of the partition, so the sketch is the windows with the least hashes, so many.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, offs in W.slices(batches, 1):
            chunk = _words(points, offs)
            place, text, least = _windows(chunk, run, shingle)
            exact = span_hashes(chunk.hashes, place, place + run)
            order = np.lexsort((exact, least, text))
            new = np.append(True, (exact[order][1:] != exact[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(order)]
            order = order[new]
            text = text[order]
            n = np.bincount(text, minlength=batch.num_rows)
            part = np.floor(np.log2(np.maximum(n, 1))).astype(np.int32)
            sketch = n - np.maximum(1, np.ceil(containment * (1 << part) - 1e-9)).astype(np.int64) + 1
            rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            columns = [batch.column(0).take(pa.array(text)), pa.array(part[text]), pa.array(rank < sketch[text]), pa.array(least[order].view(np.int64)), pa.array(exact[order].view(np.int64)), chunk.texts(place[order], run)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "part", "asked", "least", "exact", "words"])

    return map_arrow(items, work, "item_id bigint, part int, asked boolean, least bigint, exact bigint, words string")


class Leaks:
    """Documents that share a run of ``run`` words or more with an item.

    Words are runs of letters and digits in lower case of the consistent form. The MinHash of a run is the least hash of its
    shingles; equal runs have equal ones, and neighbouring runs mostly share one. Items are partitioned by size and sketched
    (``item_windows``); a document with a MinHash of a sketch is a candidate, and those of its windows that any item has
    by hash leave the scan with their words, to meet the items' windows in a join on the words themselves. The corpus is
    scanned once whatever the number of items: sketches and windows go to all as filters of bounded size (``filters``), which
    only let more through when there are more items than they are made for.

    ``containment``: the least part of an item's windows that a document must hold, at least one window.

    docs (doc_id, text), items (item_id, text, split): null ids, null and empty texts and texts of fewer than ``run`` words are in
    no pair; rows repeated with the same ids count once; other columns are ignored; empty tables give empty results.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN, shingle: int = SHINGLE, containment: float = 0.0) -> None:
        self.docs = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        self.items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"), *(["split"] if "split" in items.columns else []))
        self.doc_id, self.run, self.shingle, self.containment = doc_id, run, shingle, containment

    @cached_property
    def windows(self) -> DataFrame:
        some = self.items.where("item_id is not null and text is not null").select("item_id", "text")
        return cut_lineage(item_windows(some, self.run, self.shingle, self.containment).distinct())

    def hits(self) -> DataFrame:
        """(id, exact, words): the windows of candidate documents that any item has by hash."""
        n = self.windows.count()
        sketch, known = filter_of(self.windows.where("asked").select("least").distinct(), n), filter_of(self.windows.select("exact"), n)
        run, shingle = self.run, self.shingle

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, points, offs in W.slices(batches, 1):
                chunk = _words(points, offs)
                place, text, mine = _windows(chunk, run, shingle)
                if not len(mine):
                    continue
                new = np.append(True, (mine[1:] != mine[:-1]) | (text[1:] != text[:-1]))
                candidate = np.zeros(batch.num_rows, bool)
                candidate[text[new][among(sketch.value, mine[new])]] = True
                at = np.flatnonzero(candidate[text])
                exact = span_hashes(chunk.hashes, place[at], place[at] + run)
                hit = np.flatnonzero(among(known.value, exact))
                if len(hit):
                    at, exact = at[hit], exact[hit]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[at])), pa.array(exact.view(np.int64)), chunk.texts(place[at], run)], ["id", "exact", "words"])

        return map_arrow(self.docs, work, f"id {self.docs.schema['id'].dataType.simpleString()}, exact bigint, words string")

    def found(self) -> DataFrame:
        """(doc_id, item_id, n_windows): a row for each document and item, with the different windows of the item that it holds."""
        both = self.hits().join(self.windows.select("item_id", "exact", "words"), ["exact", "words"])
        rows = both.groupBy("id", "item_id").agg(F.count_distinct("words").alias("n_windows"))
        if self.containment > 0:
            size = self.windows.groupBy("item_id").agg(F.count_distinct("words").alias("size"))
            rows = rows.join(size, "item_id").where(F.col("n_windows") >= F.col("size") * F.lit(self.containment) - 1e-9).select("id", "item_id", "n_windows")
        return rows.withColumnRenamed("id", self.doc_id)

    def by_item(self) -> DataFrame:
        """One row per item: (item_id, split, n_windows, n_docs, most_windows, containment): its different windows, the documents
        that hold any, and the largest number and share of its windows that one document holds. Items with
        null text or fewer than ``run`` words have 0 windows and null containment."""
        have = self.windows.groupBy("item_id").agg(F.count_distinct("words").alias("n_windows"))
        hits = self.found().groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_windows").alias("most_windows"))
        rows = self.items.select("item_id", F.lower(F.trim("split")).alias("split")).join(have, "item_id", "left").join(hits, "item_id", "left")
        zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_windows", "n_docs", "most_windows")}
        return rows.withColumns(zero).withColumn("containment", F.round(F.try_divide("most_windows", "n_windows"), 6))
