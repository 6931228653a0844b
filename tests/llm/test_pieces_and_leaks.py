import random
import re

from folia.llm import leakage, lookalike, pieces

TOK = "rec_id bigint, tok_idx int, page int, block_id int, bucket string"
CFG = "config_id bigint, dataset_name string, max_length int, word_window_size int, word_window_stride int"


def plain_pieces(tokens, records, configs):
    by, out = {}, set()
    for r, k, p, b, *_ in tokens:
        if r is not None and k is not None:
            by.setdefault(r, {}).setdefault(k, (p, b))
    part = {r: re.sub(r"[\s-]", "_", n.strip().lower()) for r, n, *_ in records if n is not None}
    for c, name, longest, size, stride in configs:
        limit, back = size or longest, stride or 0
        for r, m in by.items():
            if not limit or part.get(r) != re.sub(r"[\s-]", "_", name.strip().lower()) or len(m) <= limit:
                continue
            idx, s, no = sorted(m), 0, 0
            while s + limit < len(idx):
                ends = [e for e in range(s + 1, s + limit + 1) if e > s + limit / 2 and m[idx[e - 1]] != m[idx[e]]]
                e = max(ends, default=s + limit)
                out.add((c, r, no, idx[s], idx[e - 1]))
                s, no = max(s + 1, e - back), no + 1
            out.add((c, r, no, idx[s], idx[-1]))
    return out


def test_pieces(spark):
    rng = random.Random(4)
    tokens = []
    for r in range(12):
        n = rng.choice([0, 5, 40, 200])
        blocks = r % 3 != 0
        block = 0
        for k in range(n):
            block += rng.random() < 0.1
            if rng.random() < 0.95:
                tokens.append((r, k, k // 60, block if blocks else None, "x"))
    tokens += rng.sample(tokens, 50) + [(None, 1, 1, 1, ""), (3, None, 1, 1, "")]
    rng.shuffle(tokens)
    records = [(r, ("Set-A ", " set a", "other", None)[r % 4], "z") for r in range(12)] + [(0, "Set-A ", "z")]
    configs = [(1, "set_a", 16, None, None), (2, "SET A", 64, 0, 5), (3, "other", 8, 7, 3), (4, "set_a", 10, 9, 9), (5, "none", 5, 5, 0), (6, "set_a", None, None, 1)]
    make = lambda size: pieces.pieces(spark.createDataFrame(tokens, TOK), spark.createDataFrame(records, "rec_id bigint, dataset_name string, runs string"), spark.createDataFrame(configs, CFG), size)
    want = plain_pieces(tokens, records, configs)
    for size in (8192, 7):
        got = [tuple(r) for r in make(size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for empty in (spark.createDataFrame([], TOK),):
        assert pieces.pieces(empty, spark.createDataFrame(records, "rec_id bigint, dataset_name string, z string"), spark.createDataFrame(configs, CFG)).count() == 0


def test_pieces_of_small_batches(spark):
    tokens = [(r, k, k // 7, None, "") for r in range(3) for k in range(300)]
    configs = [(1, "a", 50, None, 4)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {tuple(r) for r in pieces.pieces(spark.createDataFrame(tokens, TOK), spark.createDataFrame([(r, "a") for r in range(3)], "rec_id bigint, dataset_name string"), spark.createDataFrame(configs, CFG)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_pieces(tokens, [(r, "a") for r in range(3)], configs)


def test_pieces_whole_table(spark, data):
    from folia.llm import queries

    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(*c).collect()]
    want = plain_pieces(read("ocr_tokens", "rec_id", "tok_idx", "page", "block_id"), read("canon_docs", "rec_id", "dataset_name"), read("run_configs", "config_id", "dataset_name", "max_length", "word_window_size", "word_window_stride"))
    assert {tuple(r) for r in queries.queries()["p4_found"](spark, data).collect()} == want and want


def words(text):
    return re.findall(r"[^\W_]+", lookalike.consistent_text(text).lower()) if text else []


def plain_leaks(docs, items, run=12):
    windows = {}
    for k, t in items:
        w = words(t)
        for j in range(len(w) - run + 1):
            windows.setdefault(tuple(w[j : j + run]), set()).add(k)
    out = {}
    for k, t in docs:
        w = words(t)
        for j in range(len(w) - run + 1):
            for item in windows.get(tuple(w[j : j + run]), ()):
                out.setdefault((k, item), set()).add(tuple(w[j : j + run]))
    return {k: len(v) for k, v in out.items()}


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"wörd{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 50)))) for k in range(30)]
    items += [(40, items[0][1]), (41, None), (42, ""), (43, "to be " * 20)]
    docs = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        passage = rng.choice(items[:30])[1].split()
        n = rng.choice([0, 11, 12, 13, len(passage)])
        text[3:3] = passage[:n]
        docs.append((k, ["{}", "<b>{}</b>", "{}​."][k % 3].format((" ", ",\n")[k % 2].join(text)).upper().replace("W", "Ｗ")))
    docs += [(90, None), (91, ""), (92, "TO BE! " * 30), (0, docs[0][1]), (None, items[1][1])]
    frames = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame([(k, t, "val", "x") for k, t in items], "item_id bigint, text string, split string, words string")
    want = plain_leaks([d for d in docs if d[0] is not None], items)
    got = [tuple(r) for r in leakage.Leaks(*frames).found().collect()]
    assert len(got) == len(want) and {(d, i): n for d, i, n in got} == want
    size = {k: len({tuple(words(t)[j : j + 12]) for j in range(len(words(t)) - 11)}) for k, t in items}
    for part in (0.3, 0.8, 1.0):
        got = {(r.doc_id, r.item_id): r.n_windows for r in leakage.Leaks(*frames, containment=part).found().collect()}
        assert got == {k: n for k, n in want.items() if n >= part * size[k[1]] - 1e-9}
    report = {r.item_id: r for r in leakage.Leaks(*frames).by_item().collect()}
    assert report[41].n_windows == 0 and report[41].containment is None and report[43].n_docs == 1 and report[43].containment == 1.0
    assert report[40].n_docs == report[0].n_docs
    assert leakage.Leaks(frames[0].limit(0), frames[1]).found().count() == 0 and leakage.Leaks(frames[0], frames[1].limit(0)).found().count() == 0


def test_filters_too_small_for_the_items_change_nothing(spark, monkeypatch):
    """More windows than the filters are made for: nearly all of the corpus goes to the join, and the pairs stay."""
    from folia.llm import filters

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(80)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id bigint, text string")
    docs = [(k, " ".join(rng.choice(texts).split()[5:25] + [f"w{rng.randrange(60)}" for _ in range(20)])) for k in range(100)]
    want = plain_leaks(docs, list(enumerate(texts)))
    monkeypatch.setattr(leakage, "filter_of", lambda keys, n: filters.filter_of(keys, n, most=8))
    got = {(r.doc_id, r.item_id): r.n_windows for r in leakage.Leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).found().collect()}
    assert got == want


def test_leaks_whole_table(spark, data):
    from folia.llm import queries

    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(*c).collect()]
    want = plain_leaks(read("documents", "doc_id", "text"), read("heldout_items", "item_id", "text"))
    assert {tuple(r) for r in queries.queries()["p7_found"](spark, data).collect()} == set(want)
