import itertools
import random

import pytest

from folia.llm import encode, neardup, overlap, words
from folia.llm.neardup import NearDuplicates
from folia.llm.overlap import SplitOverlap


def grams(text, width=3):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def corpus(seed, n=60, copies=5):
    """Texts, some of them changed in some words or put in another order of sentences, some copied."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        out.append([rng.choice(vocabulary) for _ in range(rng.randrange(2, 60))])
    for k in range(n):
        base = list(rng.choice(out))
        for _ in range(rng.randrange(0, 3)):
            base[rng.randrange(len(base))] = f"new{k}"
        if rng.random() < 0.3:
            base += rng.choice(out)
        out.append(base)
    out += [out[0]] * copies
    return [" \t".join(w).upper() if k % 3 == 0 else "\n".join(w) for k, w in enumerate(out)]


def near(rows, threshold, width=3):
    sets = [(k, p, grams(t, width)) for k, p, t in rows if k is not None and p is not None]
    return {(min(a, b), max(a, b)) for (a, p, x), (b, q, y) in itertools.combinations(sets, 2) if a != b and p == q and x and y and len(x & y) >= threshold * len(x | y)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = [(k, "ab"[k % 7 == 0], t) for k, t in enumerate(corpus(seed))]
    want = near(rows, 0.7)
    found = NearDuplicates(spark.createDataFrame(rows, "id bigint, part string, text string"), 0.7, 3)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r for r in found.groups().collect()}
    assert set(groups) == {k for k, _, t in rows if grams(t)}
    parent = {k: k for k in groups}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = dict.fromkeys(groups, 0)
    for a, b in want:
        links[a] += 1
        links[b] += 1
    for k, r in groups.items():
        assert r.group_id == root(k) and r.n_links == links[k]


def test_recall_of_the_banding():
    assert neardup.recall(0.6) > 0.99 and neardup.recall(0.7) > 0.9996 and neardup.recall(0.8) > 0.999997 and neardup.recall(0.1) < 0.02


def test_odd_rows(spark):
    rows = [(1, "a", "one two three four", "k", 1), (1, "a", "one two three four", "k", 1), (2, "a", "ONE two\tthree\nfour", "k", 1), (3, "a", "one two", "k", 1), (4, "a", None, "k", 1), (5, "a", "", "k", 1), (6, None, "one two three four", "k", 1), (None, "a", "one two three four", "k", 1), (7, "b", "one two three four", "k", 1)]
    docs = spark.createDataFrame(rows, "id bigint, part string, text string, key string, groups int")
    found = NearDuplicates(docs, 0.6, 3)
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert sorted((r.id, r.group_id, r.n_links) for r in found.groups().collect()) == [(1, 1, 1), (2, 1, 1), (7, 7, 0)]
    empty = NearDuplicates(docs.limit(0), 0.6, 3)
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_hot_group_of_near_copies(spark):
    """A third of all rows are one text with small edits: classes meet by bucket, and every link is found."""
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(120):
        edited = list(base)
        edited[k % 40] = f"x{k}"
        rows.append((k, "a", " ".join(edited)))
    rows += [(1000 + k, "a", f"other text number {k} of its own {k}") for k in range(240)]
    got = {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "id bigint, part string, text string"), 0.8, 3).pairs().collect()}
    assert got == near(rows, 0.8)


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 499), (499, 498), (700, 701), (701, 700), (5, 5)]
    made = {r.node: r.root for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(made[k] == 0 for k in range(201)) and made[500] == made[499] == 498 and made[701] == 700
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def contained(rows, threshold):
    out = set()
    for (a, e, x), (b, f, y) in itertools.product([(k, e, grams(t)) for k, e, t in rows], repeat=2):
        if a != b and e is True and f is False and x and len(x & y) >= threshold * len(x):
            out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_overlap(spark, seed):
    rows = [(k, (True, False, None)[k % 3], t) for k, t in enumerate(corpus(seed))]
    found = SplitOverlap(spark.createDataFrame(rows, "id bigint, is_eval boolean, text string"), 0.75, 3)
    got = [tuple(r) for r in found.pairs().collect()]
    want = contained(rows, 0.75)
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.id for r in found.affected().collect()} == {k for k, e, t in rows if e and any(k in p for p in want)}


def test_overlap_odd_rows(spark):
    rows = [(1, True, "a b c d", "g"), (1, True, "a b c d", "g"), (2, False, "A B c d", "g"), (3, False, "x a b c d y", "g"), (4, True, None, "g"), (5, False, "", "g"), (6, None, "a b c d", "g"), (None, False, "a b c d", "g"), (7, True, "a b", "g")]
    docs = spark.createDataFrame(rows, "id bigint, is_eval boolean, text string, gram string")
    assert {tuple(r) for r in SplitOverlap(docs, 0.75, 3).pairs().collect()} == {(1, 2), (1, 3)}
    assert SplitOverlap(docs.limit(0), 0.75, 3).pairs().count() == 0
    common = [(k, k % 2 == 0, f"the same words here {k} {k} {k}") for k in range(300)]
    assert SplitOverlap(spark.createDataFrame(common, "id bigint, is_eval boolean, text string"), 0.75, 3).pairs().count() == 0


def test_queries_against_plain(spark, data):
    from folia.llm import queries

    made = queries.queries()
    canon = spark.read.parquet(f"{data}/canon_docs.parquet")
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in canon.select("rec_id", encode.plain_name(F.col("dataset_name")), "text").collect()]
    assert {tuple(r) for r in made["p1_found"](spark, data).collect()} == near(rows, 0.6)
    sides = {"train": False, "val": True, "test": True}
    rows = [(k, sides.get(s), t) for k, s, t in canon.select("rec_id", encode.plain_split(F.col("split")), "text").collect()]
    assert {tuple(r) for r in made["p2_found"](spark, data).collect()} == contained(rows, 0.75)


def test_common_counts():
    import numpy as np

    left = (np.array([1, 2, 3, 9], np.uint64), np.array([0, 3, 3, 4]))
    right = (np.array([2, 3, 9], np.uint64), np.array([0, 2, 2, 3]))
    assert words.common_counts(left, right).tolist() == [2, 0, 1]
