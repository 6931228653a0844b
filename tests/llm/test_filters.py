import numpy as np
import pyarrow as pa

from folia.llm import filters, neardup


def test_filter_lets_all_of_its_keys_through(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, 20_000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key bigint").repartition(5)
    shipped = filters.filter_of(df, len(keys))
    assert filters.among(shipped.value, keys).all()
    assert filters.among(shipped.value, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    wanted = spark.createDataFrame([(int(k), "x") for k in keys[:50]] + [(7, "y")], "key bigint, v string")
    assert filters.passing(wanted, "key", shipped).where("v = 'x'").count() == 50
    assert not filters.filter_of(df.limit(0), 0).value.any()


def test_a_filter_too_small_lets_more_through_never_less(spark):
    keys = np.arange(50_000)
    table = np.zeros(1 << 9, np.uint8)
    filters.add_keys(table, keys)
    assert filters.among(table, keys).all()


def test_counters_keep_the_order(spark):
    rows = [(k % 50 if k % 3 else 7,) for k in range(3000)]

    def fill(batches, table):
        counts = np.zeros(len(table))
        for b in batches:
            np.add.at(counts, filters.counter_places(len(table), b.column(0).to_numpy()), 1)
        return filters.to_log(counts)

    made = filters.gather(spark.createDataFrame(rows, "key bigint").repartition(4), fill, 1 << 16, counts=True).value
    at = filters.counter_places(1 << 16, np.array([7, 8, 1000]))
    assert made[at[0]] > made[at[1]] > made[at[2]] == 0


def test_runs_over_batches(monkeypatch):
    """Pairs within runs and rows for pairing across them, wherever batches end."""
    monkeypatch.setattr(neardup, "RUN", 8)
    rng = np.random.default_rng(7)
    sizes = [1, 25, 1, 1, 8, 2, 1, 16, 9, 1, 3]
    key = np.repeat(np.arange(len(sizes)) * 3, sizes)
    n = np.concatenate([np.sort(rng.integers(1, 12, k)) for k in sizes])
    rep = rng.permutation(len(key))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(rep)], ["key", "n", "rep"])
    place = np.concatenate([np.arange(k) for k in sizes])
    size = np.repeat(sizes, sizes)
    want = {(min(rep[i], rep[j]), max(rep[i], rep[j])) for i in range(len(key)) for j in range(i) if key[i] == key[j] and place[i] // 8 == place[j] // 8 and n[j] >= 0.5 * n[i]}
    across = {(int(key[i]), int(n[i]), int(place[i] // 8), int(rep[i])) for i in range(len(key)) if size[i] > 8}
    for step in (1, 2, 5, 7, 8, 9, 1000):
        batches = [rows.slice(k, step) for k in range(0, len(key), step)]
        made = pa.Table.from_batches(neardup._pairs_of_runs(0.5)(iter(batches))).to_pylist()
        assert {(r["a"], r["b"]) for r in made if r["b"] is not None} == want
        single = [(r["key"], r["n"], r["run"], r["a"]) for r in made if r["b"] is None]
        assert len(single) == len(set(single)) and set(single) == across, step
    assert list(neardup._pairs_of_runs(0.5)(iter([]))) == []


def test_hot_key_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RUN", 16)
    rows = [(k, "a", " ".join(f"w{j}" if j != 10 or k % 5 else f"x{k}" for j in range(30 + k % 3))) for k in range(90)]
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "id bigint, part string, text string"), 0.5, 3)
    sets = {k: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for k, _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in found.pairs().collect()} == want


def test_pairs_are_cut_by_the_shingles_of_both_sides():
    sizes = np.array([1010] * 20)
    made = list(neardup.pair_chunks(sizes, 5000))
    assert made[0] == (0, 4) and made[-1][1] == 20 and all(b - a <= 5 for a, b in made)
    assert list(neardup.pair_chunks(sizes, 10)) == [(k, k + 1) for k in range(20)]
    assert list(neardup.pair_chunks(np.zeros(0, np.int64))) == []


def test_a_text_in_many_pairs(spark):
    texts = ["a b c d e", "a b c d f", "a b c", "x y", "", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "a bigint, b bigint")
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    made = {(r.a, r.b): (r.common, r.n_a, r.n_b) for r in neardup.compare(pairs, docs, 3).collect()}
    assert made == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in range(6) for b in range(6) if a != b}
