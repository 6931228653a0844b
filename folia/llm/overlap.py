"""Records of evaluation splits that stand, wholly or nearly, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import words as W
from folia.llm.filters import MOST_COUNTERS, add_keys, among, counter_places, filter_of, gather, log_bits, to_log
from folia.llm.neardup import compare
from folia.session import cut_lineage, map_arrow


def _digests(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, is_eval, text) -> (id, is_eval, c1, c2, n), without texts of fewer than ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, offs in W.slices(batches, 2):
            hashes, rows = W.distinct_shingles(points, offs, width)
            n = np.diff(rows)
            keep = np.flatnonzero(n)
            c1, c2 = W.set_digests(hashes, rows)
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(c1[keep]), pa.array(c2[keep]), pa.array(n[keep])], ["id", "is_eval", "c1", "c2", "n"])

    return map_arrow(docs, run, "id bigint, is_eval boolean, c1 bigint, c2 bigint, n bigint")


def _sets(docs: DataFrame, width: int, work, schema: str) -> DataFrame:
    """docs (id, text) through ``work(ids, hashes, place, n)``: the distinct shingles of texts with different sets, their text's
    place among the ids, and each text's number. A task meets copies of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, place, n in distinct_sets(batches, width):
            made = work(ids, hashes, place, n)
            if made.num_rows:
                yield made

    return map_arrow(docs, run, schema)


def distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, place in ids, number of each) of chunks of (id, text), without texts whose set came before."""
    seen: set = set()
    for batch, points, offs in W.slices(batches, 1):
        hashes, rows = W.distinct_shingles(points, offs, width)
        keep = np.flatnonzero(np.diff(rows))
        c1, c2 = W.set_digests(hashes, rows)
        keep = keep[W.first_of_class(c1[keep], c2[keep], seen)]
        if len(keep):
            yield batch.column(0).take(pa.array(keep)), *W.take_sets(hashes, rows, keep), np.diff(rows)[keep]


class SplitOverlap:
    """Pairs of an evaluation and a training record with at least ``threshold`` of the first's shingles in the second.

    The word n-gram hashes of the evaluation side become a filter that goes to all; training is scanned for hits:

    1. a filter of all evaluation shingles; training shingles in it are counted in a table of counters;
    2. of each evaluation record with n shingles the n - ceil(threshold * n) + 1 that training has least often
       are asked for: one of them must be in any training record that contains enough, whatever the order, so nothing
       is missed, and phrases that many records share are asked for only where a text has little else;
    3. training is scanned for the shingles asked for; only hits leave the scan and meet those who ask in a join;
    4. the containment of each hit is counted over whole texts.

    Filter and counters have a size by count, up to a limit (``filters``). A larger evaluation side makes them
    less sharp: more rows go to the join and more candidates are compared; the pairs stay the same.

    docs: (id, is_eval, text); is_eval null (no split), null ids, null and empty texts and texts of fewer than
    ``width`` words are in no pair; rows repeated with the same id count once; empty tables give empty results.
    """

    def __init__(self, docs: DataFrame, threshold: float, width: int) -> None:
        docs = docs.where("id is not null and is_eval is not null and text is not null")
        self.docs = docs.select(F.col("id").cast("bigint").alias("id"), "is_eval", "text")
        digests = cut_lineage(_digests(self.docs, width)).distinct()
        keys = ["c1", "c2", "n"]
        classes = digests.groupBy(*keys).agg(F.min("id").alias("rep"), F.max("is_eval").alias("evals"), F.min("is_eval").alias("only_eval"))
        self.classes = cut_lineage(classes.select(*keys, "rep", "evals", (~F.col("only_eval")).alias("trains")))
        self.members = cut_lineage(digests.join(self.classes, keys).select("id", "is_eval", "rep"))
        self.threshold, self.width = threshold, width

    def _asked(self, evals: DataFrame, trains: DataFrame) -> DataFrame:
        """(gram, a): the shingles that are looked up for each evaluation record."""
        width, threshold = self.width, self.threshold
        n = self.classes.where("evals").agg(F.sum("n")).first()[0] or 0
        bits = log_bits(n)

        def fill(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> np.ndarray:
            for _, hashes, _, _ in distinct_sets(batches, width):
                add_keys(table, hashes)
            return table

        known = gather(evals, fill, 1 << (bits - 3))

        def tally(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> np.ndarray:
            counts = np.zeros(len(table), np.float64)
            for _, hashes, _, _ in distinct_sets(batches, width):
                place, often = np.unique(counter_places(len(table), hashes[among(known.value, hashes)]), return_counts=True)
                counts[place] += often
            return to_log(counts)

        often = gather(trains, tally, 1 << log_bits(n, 1, 16, MOST_COUNTERS), counts=True)

        def rarest(ids: pa.Array, hashes: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(often.value[counter_places(len(often.value), hashes)], kind="stable")
            order = order[W.by_group(place[order], len(n))]
            take = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            order = order[rank < take[place]]
            return pa.RecordBatch.from_arrays([pa.array(hashes[order].view(np.int64)), ids.take(pa.array(place[order]))], ["gram", "a"])

        return _sets(evals, width, rarest, "gram bigint, a bigint")

    def candidates(self) -> DataFrame:
        """(a, b): representatives of an evaluation and a training class that have a shingle asked for in common."""
        evals, trains = (self.docs.where(F.col("is_eval") == side).select("id", "text") for side in (True, False))
        asked = cut_lineage(self._asked(evals, trains))
        shipped = filter_of(asked.select("gram"), asked.count())

        def hits(ids: pa.Array, hashes: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            on = np.flatnonzero(among(shipped.value, hashes))
            return pa.RecordBatch.from_arrays([pa.array(hashes[on].view(np.int64)), ids.take(pa.array(place[on]))], ["gram", "b"])

        found = asked.join(_sets(trains, self.width, hits, "gram bigint, b bigint"), "gram").select("a", "b").distinct()
        for side in "ab":
            found = found.join(self.members.select(F.col("id").alias(side), F.col("rep").alias(f"rep_{side}")), side)
        return found.where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()

    def class_pairs(self) -> DataFrame:
        """(a, b): an evaluation class and a training class, by representative; a = b where a class has both."""
        counted = compare(self.candidates(), self.docs.select("id", "text"), self.width)
        found = counted.where(F.col("common") >= F.col("n_a") * F.lit(self.threshold) - 1e-9).select("a", "b").distinct()
        same = self.classes.where("evals and trains")
        return found.union(same.select(F.col("rep").alias("a"), F.col("rep").alias("b")))

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b), rec_a < rec_b: every pair of an evaluation and a training record."""
        left = self.members.where("is_eval").select(F.col("rep").alias("a"), F.col("id").alias("x"))
        right = self.members.where("not is_eval").select(F.col("rep").alias("b"), F.col("id").alias("y"))
        return self.class_pairs().join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()

    def affected(self) -> DataFrame:
        """(id): the evaluation records that are in a pair; copies aren't expanded into pairs for it."""
        return self.members.where("is_eval").join(self.class_pairs().select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select("id")
