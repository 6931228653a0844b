"""Near-duplicate records within a data set, by tensored MinHash banding and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import words as W
from folia.llm.columns import chunks, code_points, mix64, string_array
from folia.llm.filters import filter_of, passing
from folia.session import cut_lineage, map_arrow

#: Small hash collections, and MinHash values in each. A table key joins two collections, so 16 * 2 hashes
#: give 120 tables of 4 values: plain banding would need 480 hashes. At similarity 0.6 a pair is found
#: with probability 0.992, at 0.7 with 0.9997, at 0.8 with 0.999998.
COLLECTIONS, EACH = 16, 2
#: Rows of a table key that are paired with as many others in one task.
RUN = 1024


def recall(similarity: float, collections: int = COLLECTIONS, each: int = EACH) -> float:
    """Probability that a pair of this similarity shares a table key, that is, agrees in two collections."""
    p = similarity**each
    return 1 - (1 - p) ** collections - collections * p * (1 - p) ** (collections - 1)


def signatures(docs: DataFrame, width: int, collections: int, each: int) -> DataFrame:
    """docs (id, part, text) -> (id, part, c1, c2, n, groups): digests of the distinct shingles, their
    number, and one hash for each collection. Texts with fewer than ``width`` words are left out."""
    seeds = mix64(np.arange(1, collections * each + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, offs in W.slices(batches, 2):
            hashes, rows = W.distinct_shingles(points, offs, width)
            n = np.diff(rows)
            keep = np.flatnonzero(n)
            if not len(keep):
                continue
            c1, c2 = W.set_digests(hashes, rows)
            groups = np.zeros((len(keep), collections), np.uint64)
            for k, seed in enumerate(seeds):
                least = np.minimum.reduceat(mix64(hashes ^ seed), rows[keep])
                groups[:, k // each] = mix64(groups[:, k // each] ^ least)
            lists = W.as_lists(groups.reshape(-1), np.arange(len(keep) + 1) * collections)
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(c1[keep]), pa.array(c2[keep]), pa.array(n[keep]), lists], ["id", "part", "c1", "c2", "n", "groups"])

    return map_arrow(docs, run, "id bigint, part string, c1 bigint, c2 bigint, n bigint, groups array<bigint>")


#: Shingles of both sides that are counted at a time.
COUNTED = 1 << 18


def pair_chunks(sizes: np.ndarray, limit: int = COUNTED) -> Iterator[tuple[int, int]]:
    """Ranges of pairs with at most ``limit`` shingles on both sides together; a larger pair is a range of its own."""
    ends = np.append(0, np.cumsum(sizes))
    lo, n = 0, len(sizes)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the distinct shingles of texts, made chunk by chunk."""
    parts = [W.distinct_shingles(*code_points(texts.slice(lo, hi - lo))[:2], width) for lo, hi in chunks(texts)]
    offs = np.append(0, np.cumsum(np.concatenate([np.diff(o) for _, o in parts])))
    return np.concatenate([h for h, _ in parts]), offs


def compare(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) with texts (id, text) -> (a, b, common, n_a, n_b), counted over distinct shingles of the whole texts.

    Only texts that a pair names are moved: the scan drops the others by a filter of the ids.
    """
    pairs = cut_lineage(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = passing(texts, "id", filter_of(named, 2 * pairs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # a text that comes in many pairs of a batch is cut into shingles once
            coded = pa.concat_arrays([string_array(batch.column(k)) for k in (2, 3)]).dictionary_encode()
            hashes, offs = _sets(coded.dictionary, width)
            at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = at[: batch.num_rows], at[batch.num_rows :]
            n = np.diff(offs)
            common = [W.common_counts(W.sets_at(hashes, offs, a[lo:hi]), W.sets_at(hashes, offs, b[lo:hi])) for lo, hi in pair_chunks(n[a] + n[b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, (np.concatenate(common), n[a], n[b]))], ["a", "b", "common", "n_a", "n_b"])

    sides = [some.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
    return map_arrow(both, run, "a bigint, b bigint, common bigint, n_a bigint, n_b bigint")


def _pairs_of_runs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (key, n, rep) -> (key, n, run, a, b): the pairs a < b of each run, and, with b null, the rows of keys with several runs.

    Rows alone with their key end here. Only the last run, of RUN rows at most, is carried from batch to batch.
    """
    names = ["key", "n", "run", "a", "b"]

    def pairs(group: np.ndarray, n: np.ndarray, rep: np.ndarray) -> pa.RecordBatch | None:
        found, step = [], 1
        at = np.arange(len(group) - 1)
        while len(at):  # pairs of neighbours, of second neighbours and so on, as far as groups reach
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            near = at[n[at] >= n[at + step] * threshold - 1e-9]
            found.append(np.stack([np.minimum(rep[near], rep[near + step]), np.maximum(rep[near], rep[near + step])], axis=1))
            step += 1
        made = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        if not len(made):
            return None
        none = pa.nulls(len(made), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), pa.array(made[:, 0]), pa.array(made[:, 1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.zeros(0, np.int64)] * 3  # key, n, rep of the last run, and which run of its key it is
        number = 0

        def done(key: np.ndarray, n: np.ndarray, rep: np.ndarray, of_key: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole runs; ``more``: rows of keys with several."""
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (of_key[1:] != of_key[:-1])))
            if len(key) and (made := pairs(group, n, rep)) is not None:
                yield made
            out = np.flatnonzero(more)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(n[out]), pa.array(of_key[out].astype(np.int32)), pa.array(rep[out]), pa.nulls(len(out), pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, rep = (np.append(x, c.to_numpy(zero_copy_only=False)) for x, c in zip(carried, batch.columns, strict=True))
            place = np.arange(len(key))
            begins = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(begins, place, 0))
            of_key = (place - first) // RUN + np.where(first == 0, number, 0)
            last = len(key) - 1 - int(np.argmax((key[::-1] != key[-1]) | (of_key[::-1] != of_key[-1]))) if (key[0] != key[-1] or of_key[0] != of_key[-1]) else -1
            # a key has several runs if any row of it is in a later one
            several = np.maximum.reduceat(of_key, np.flatnonzero(begins)) > 0
            more = several[np.cumsum(begins) - 1]
            whole = slice(0, last + 1)
            yield from done(key[whole], n[whole], rep[whole], of_key[whole], more[whole])
            carried, number = [key[last + 1 :], n[last + 1 :], rep[last + 1 :]], int(of_key[-1])
        if len(carried[0]):
            yield from done(*carried, np.full(len(carried[0]), number), np.full(len(carried[0]), number > 0))

    return run


class NearDuplicates:
    """Records of one part (data set) whose shingle sets have at least a Jaccard similarity of ``threshold``.

    Records with equal sets form a class first, so copies meet once; table keys join pairs of collections;
    classes that share a key are candidates; candidates are verified by exact counts over whole texts.

    docs: (id, part, text). Null ids, null parts, null and empty texts and texts of fewer than ``width``
    words have no partner; rows repeated with the same id count once; an empty table gives empty results.
    The table is read by these three columns only, so further ones may have any names.
    """

    def __init__(self, docs: DataFrame, threshold: float, width: int, collections: int = COLLECTIONS, each: int = EACH) -> None:
        docs = docs.where("id is not null and part is not null and text is not null")
        docs = docs.select(F.col("id").cast("bigint").alias("id"), "part", "text")
        self.texts = docs.select("id", "text")
        self.members = cut_lineage(signatures(docs, width, collections, each))
        self.classes = self.members.groupBy("part", "c1", "c2", "n").agg(F.min("id").alias("rep"), F.first("groups").alias("groups"))
        self.threshold, self.width, self.collections = threshold, width, collections

    def candidates(self) -> DataFrame:
        """(a, b), a < b: classes that share a table key.

        The rows of a key are sorted once, by the size of their sets; rows alone with their key, which most are, end there. The
        others are cut into runs of ``RUN`` rows, which are paired where they are sorted; of keys with several, each two runs are
        a key of their own for pairing: what a hot key has is spread over as many tasks as it has pairs of runs. Sets of which the
        smaller has less than ``threshold`` of the other's size can't be similar enough and aren't paired.
        """
        first = [i for i in range(self.collections) for _ in range(i + 1, self.collections)]
        other = [j for i in range(self.collections) for j in range(i + 1, self.collections)]
        at = lambda places, t: F.element_at(F.array(*map(F.lit, places)), t)
        # the table's number above 41 bits of hash: zero bytes above them cost nothing in a shuffle
        key = lambda t: F.shiftleft(t.cast("bigint"), 41).bitwiseOR(F.shiftrightunsigned(F.xxhash64("part", F.element_at("groups", at(first, t) + 1), F.element_at("groups", at(other, t) + 1)), 23))
        tables = self.classes.select("n", "rep", F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(first))), key)).alias("key"))
        rows = tables.select("key", "n", "rep").repartition("key").sortWithinPartitions("key", "n", "rep")
        made = cut_lineage(map_arrow(rows, _pairs_of_runs(self.threshold), "key bigint, n bigint, run int, a bigint, b bigint"))
        runs = made.where("b is null").select("key", "n", "run", F.col("a").alias("rep"))
        last = runs.groupBy("key").agg(F.max("run").alias("last"))
        blocks = runs.join(last, "key").select("key", "n", "rep", "run", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("to")).where("run <> to")
        left = blocks.where("run < to").select("key", F.col("run").alias("lo"), F.col("to").alias("hi"), F.col("n").alias("n_x"), F.col("rep").alias("x"))
        right = blocks.where("run > to").select("key", F.col("to").alias("lo"), F.col("run").alias("hi"), F.col("n").alias("n_y"), F.col("rep").alias("y"))
        # sorted by size, so a lower run has none larger
        across = left.join(right, ["key", "lo", "hi"]).where(F.col("n_x") >= F.col("n_y") * F.lit(self.threshold) - 1e-9).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return made.where("b is not null").select("a", "b").unionByName(across).distinct()

    def links(self) -> DataFrame:
        """(a, b), a < b: verified pairs of class representatives (the least id of each class)."""
        counted = compare(self.candidates(), self.texts, self.width)
        return counted.where(F.col("common") >= F.lit(self.threshold) * (F.col("n_a") + F.col("n_b") - F.col("common")) - 1e-9).select("a", "b").distinct()

    def membership(self) -> DataFrame:
        """(id, part, rep): the class of each record."""
        keys = ["part", "c1", "c2", "n"]
        return self.members.select("id", *keys).distinct().join(self.classes.select(*keys, "rep"), keys).select("id", "part", "rep")

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b), rec_a < rec_b: all pairs of records, copies included, as far as the result needs them."""
        member = cut_lineage(self.membership())
        left, right = member.select(F.col("rep").alias("a"), F.col("id").alias("x")), member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links().join(left, "a").join(right, "b").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
        within = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("rec_a"), F.col("y").alias("rec_b"))
        return across.unionByName(within)

    def groups(self) -> DataFrame:
        """One row for each record with three words or more: id, part, class_id, group_id (least id of all that
        are linked, directly or not) and n_links, the number of other records that it is similar to."""
        links = cut_lineage(self.links())
        member = cut_lineage(self.membership())
        size = member.groupBy("rep").agg(F.count("*").alias("size"))
        ends = links.select(F.col("a").alias("rep"), F.col("b").alias("to")).union(links.select(F.col("b"), F.col("a")))
        far = ends.join(size.withColumnRenamed("rep", "to"), "to").groupBy("rep").agg(F.sum("size").alias("far"))
        root = components(links)
        rows = member.join(size, "rep").join(far, "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
        n_links = F.col("size") - 1 + F.coalesce("far", F.lit(0))
        return rows.select("id", "part", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), n_links.cast("bigint").alias("n_links"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root): the least node of each connected component.

    Alternating large and small stars: each round replaces links by links to the least neighbour; the number
    of rounds grows with the logarithm of the size. Only counts come to the driver. After ``most_rounds``, far
    beyond what any real size takes, the query fails; it never gives unsettled groups.
    """
    edges = cut_lineage(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(near, "hi").select(F.least("m", "lo").alias("lo"), F.when(F.col("m") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        small = small.union(near.select(F.col("m").alias("lo"), "hi")).where("lo <> hi").distinct()
        edges = cut_lineage(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components didn't settle")
    roots = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return roots.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
