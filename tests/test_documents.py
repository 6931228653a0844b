import pytest
from pyspark.sql import functions as F

from folia.operators import align, documents, lineitems, metrics, quality, records, results, serialize, splits, windows

TOKENS = "doc_id bigint, tok_idx int, text string, char_start int, char_end int, page int, x0 int, y0 int, x1 int, y1 int, page_width int, page_height int, block_id int"


def tokens(spark, rows):
    """rows: (doc_id, tok_idx, text, start, x0, y0, x1, y1[, page])."""
    return spark.createDataFrame([(d, k, t, s, s + len(t), (r or [0])[0], x0, y0, x1, y1, 1000, 1000, None) for d, k, t, s, x0, y0, x1, y1, *r in rows], TOKENS)


def labelled(spark, labels, doc=1):
    rows = tokens(spark, [(doc, k, f"w{k}", 3 * k, 10 * k, 10, 10 * k + 8, 20) for k in range(len(labels))])
    names = spark.createDataFrame([(doc, k, x) for k, x in enumerate(labels)], "doc_id bigint, tok_idx int, label string")
    return rows.join(names, ["doc_id", "tok_idx"])


def items(spark, src, texts=None, roles=None, doc=1):
    rows = [(doc, k, (texts or {}).get(k, "x"), s, (roles or {}).get(k, "ocr_token" if s is not None else "page")) for k, s in enumerate(src)]
    return spark.createDataFrame(rows, "doc_id bigint, pos int, text string, src int, role string")


def annotations(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, ann_idx int, label string, char_start int, char_end int, text string")


def test_clean_tokens(spark):
    schema = "rec_id bigint, tok_idx int, text string, char_start int, char_end int, page int, x0 int, y0 int, x1 int, y1 int, page_width int, page_height int, block_id int, loaded_at int, text_2 string"
    rows = [(1, 0, "old", 0, 3, 0, 9, 1, 2, 5, 10, 10, None, 1, "z"), (1, 0, "new", 0, 3, 0, 9, 1, 2, 5, 10, 10, None, 2, "z"), (1, 1, None, 0, 0, 0, 1, 1, 2, 2, None, None, 3, 1, None), (None, 1, "a", 0, 1, 0, 1, 1, 2, 2, 1, 1, 1, 1, ""), (2, None, "a", 0, 1, 0, 1, 1, 2, 2, 1, 1, 1, 1, "")]
    made = documents.clean_tokens(spark.createDataFrame(rows, schema)).orderBy("tok_idx").collect()
    assert [(r.tok_idx, r.text, r.x0, r.x1, r.block_id) for r in made] == [(0, "new", 2, 9, None), (1, "", 1, 2, 3)]
    assert documents.clean_tokens(spark.createDataFrame([], schema)).count() == 0


def labels_of(df, order="tok_idx", column="label"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_alignment(spark):
    toks = tokens(spark, [(1, 0, "Total", 0, 0, 0, 5, 5), (1, 1, "$150.00P-2", 6, 0, 0, 5, 5), (1, 2, "due", 17, 0, 0, 5, 5), (1, 3, "", 21, 0, 0, 5, 5)])
    anns = annotations(spark, [(1, 0, "Gross Amount", 6, 16, "150.00"), (1, 1, "Agency", 0, 16, "Total 150"), (1, 2, "Agency", 500, 600, "gone"), (1, 3, "Date", 17, 18, "d")])
    assert labels_of(align.bio_labels(toks, anns)) == ["B-agency", "I-agency", "O", "O"]
    assert labels_of(align.bio_labels(toks, anns, "overwrite")) == ["B-agency", "B-gross_amount", "O", "O"]
    with pytest.raises(Exception, match="more than one label"):
        align.bio_labels(toks, anns, "error").collect()
    found = sorted(tuple(r) for r in align.issues(toks, anns).fillna(-1).collect())
    assert found == [(1, "label_conflict", 0, 1), (1, "no_token_match", 2, -1), (1, "no_token_match", 3, -1)]
    checked = {r.ann_idx: r for r in align.checks(toks, anns).collect()}
    assert (checked[0].status, checked[0].strict_match, checked[2].status, checked[2].n_tokens, checked[2].token_text) == ("ok", False, "unavailable", 0, "")
    assert align.hits(toks, anns, touching=True).where("ann_idx = 3").count() == 0
    assert align.hits(toks, anns, stretch=4).select("ann_idx", "tok_idx").exceptAll(align.hits(toks, anns).select("ann_idx", "tok_idx")).count() == 0
    empty = anns.limit(0)
    assert labels_of(align.bio_labels(toks, empty)) == ["O"] * 4 and align.issues(toks, empty).count() == 0


def test_spans(spark):
    rows = labelled(spark, ["B-a", "I-a", "I-b", "O", "I-b", "B-b", "odd", "odd", "X-a"])
    made = [(r.label, r.token_start, r.token_end) for r in align.spans(rows).orderBy("token_start").collect()]
    assert made == [("a", 0, 1), ("b", 2, 2), ("b", 4, 4), ("b", 5, 5), ("odd", 6, 6), ("odd", 7, 7)]
    values = {r.label: (r.n_values, r.is_list, r.value) for r in align.field_values(align.spans(rows), normalize=False).collect()}
    assert values["a"] == (1, False, "w0 w1") and values["b"] == (3, True, "w2|w4|w5")


def test_line_items(spark):
    rows = [(1, 0, 0, 10, 0, 20, 0, "line_item_rate", "a"), (1, 0, 0, 12, 50, 22, 1, "line_item_date", "b"), (1, 0, 0, 60, 0, 70, 2, "line_item_rate", "c"), (1, 0, 0, 60, 0, 70, 3, "agency", "d")]
    spans = spark.createDataFrame(rows, "doc_id bigint, page int, z int, y0 int, x0 int, y1 int, token_start int, label string, text string")
    assert sorted((r.row_no, r.cell_no, r.text) for r in lineitems.rows_of_items(spans).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_relabel(spark):
    def made(labels, src, strict=False):
        return labels_of(records.relabel(items(spark, src), labelled(spark, labels), strict), "pos")

    assert made(["B-X", "I-X"], [1, None, 0]) == ["B-X", None, "I-X"]
    assert made(["B-X", "I-X", "O", "B-X"], [0, 3, 1]) == ["B-X", "B-X", "B-X"]
    assert made(["Z-X", "I-X"], [0, 1]) == ["B-X", "I-X"]
    assert made(["Z-X", "I-X"], [0, 1], strict=True) == ["O", "B-X"]


def test_collapse(spark):
    rows = items(spark, [0, None, 0, 1]).withColumn("label", F.element_at(F.array(*map(F.lit, ["O", "B-z", "B-x", "O"])), F.col("pos") + 1))
    assert labels_of(records.collapse(rows)) == ["B-x", "O"] and labels_of(records.collapse(rows, "last")) == ["B-x", "O"] and labels_of(records.collapse(rows, "error")) == ["B-x", "O"]


def test_strategies_cover_every_token(spark, data):
    from folia.plans import adapters

    toks = adapters.tokens(spark, data)
    blocks = adapters.blocks(toks)
    n = toks.count()
    for name in serialize.STRATEGIES:
        made = serialize.strategy(name)(toks, blocks)
        real = made.where("src is not null")
        assert real.count() == n, name
        assert records.problems(made, toks).count() == 0, name
        bounds = made.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("k"), F.max("pos").alias("m"))
        assert bounds.where("n <> k or m <> n - 1").count() == 0, name
        assert serialize.strategy(name)(toks.limit(0), blocks.limit(0)).count() == 0, name
    with pytest.raises(KeyError, match="plain_text"):
        serialize.strategy("none")


def test_block_markers(spark):
    toks = tokens(spark, [(1, k, "abcd", 5 * k, 0, 0, 1, 1, k // 3) for k in range(4)])
    blocks = spark.createDataFrame([(1, 7, 0, 0, 6, 0), (1, 8, 0, 4, 10, 0), (1, 9, 1, 0, 0, 0)], "doc_id bigint, block_id int, page int, char_start int, char_end int, n int")
    texts = labels_of(serialize.block_aware(toks, blocks), "pos", "text")
    assert texts == ["[PAGE_0]", "[BLOCK_7]", "abcd", "[BLOCK_8]", "abcd", "[BLOCK_UNK]", "abcd", "[PAGE_1]", "[BLOCK_UNK]", "abcd"]


def test_target(spark):
    anns = annotations(spark, [(1, 0, "Agency", 0, 1, 'A "x"'), (1, 1, "Line Item - Rate", 2, 3, "$5"), (1, 2, "Line Item - Rate", 4, 5, "$6"), (1, 3, "Line Item - Date", 6, 7, "1 May")])
    assert serialize.target(anns).first().target_text == r'{"agency": "A \"x\"", "line_item_date": "1May", "line_item_rate": ["5", "6"]}'
    assert serialize.target(anns, line_items=True).first().target_text == r'{"agency": "A \"x\"", "line_items": [{"date": "1May", "rate": "5"}, {"rate": "6"}]}'


def test_training_text(spark):
    rows = items(spark, [None, 0, 1], {0: "[R_12]", 1: " ", 2: "a"}, {0: "row_bucket"})
    assert labels_of(windows.training_text(rows), "pos", "text") == ["[LAYOUT_ROW] [R_12]", "<EMPTY_OCR>", "a"]


def fair(spark, labels, strategies, max_length, **options):
    rows = None
    for name, src, roles in strategies:
        part = items(spark, src, roles=roles).withColumn("strategy", F.lit(name)).withColumn("pieces", F.lit(1))
        rows = part if rows is None else rows.unionByName(part)
    made = windows.fair_windows(rows, labelled(spark, labels), max_length, **options)
    return sorted((r.strategy, r.chunk_index, r.word_start, r.word_end, list(r.places)) for r in made.collect())


def test_fair_windows(spark):
    plain = ("plain_text", [0, 1, 2, 3], {})
    heavy = ("rowcol_bucket", [None, None, 0, None, None, 1, None, None, 2, None, None, 3], {k: "row_bucket" for k in range(12)} | {2: "ocr_token", 5: "ocr_token", 8: "ocr_token", 11: "ocr_token"})
    made = fair(spark, ["O"] * 4, [plain, heavy], 8)
    assert [x[:4] for x in made] == [("plain_text", 0, 0, 2), ("plain_text", 1, 2, 4), ("rowcol_bucket", 0, 0, 2), ("rowcol_bucket", 1, 2, 4)]
    long = fair(spark, ["B-X"] + ["I-X"] * 9, [("plain_text", list(range(10)), {})], 8)
    assert [(x[2], x[3]) for x in long] == [(0, 6), (6, 10)]
    whole = fair(spark, ["O", "O", "B-X", "I-X", "I-X"], [("plain_text", list(range(5)), {})], 5)
    assert [(x[2], x[3]) for x in whole] == [(0, 2), (2, 5)]
    over = fair(spark, ["O"] * 5, [("plain_text", list(range(5)), {})], 5, piece_stride=1)
    assert [(x[2], x[3]) for x in over] == [(0, 3), (2, 5)]
    with pytest.raises(Exception, match="incomplete OCR source coverage"):
        fair(spark, ["O"] * 5, [plain], 8)
    with pytest.raises(Exception, match="takes more than"):
        fair(spark, ["O"] * 4, [heavy], 4)


def test_markers_repeat_in_windows(spark):
    made = fair(spark, ["O"] * 4, [("line_aware", [None, None, 2, None, 0, 1, 3], {0: "page", 1: "line", 3: "line", 2: "ocr_token", 4: "ocr_token", 5: "ocr_token", 6: "ocr_token"})], 7)
    assert [x[2:] for x in made] == [(0, 2, [0, 3, 4, 5]), (2, 4, [0, 1, 2, 3, 6])]


def test_word_windows(spark):
    rows = items(spark, list(range(10)))
    assert sorted((r.word_start, r.word_end) for r in windows.word_windows(rows, 4, 1).collect()) == [(0, 4), (3, 7), (6, 10)]
    assert [(r.word_start, r.word_end) for r in windows.word_windows(rows, 0, 0).collect()] == [(0, 10)]
    with pytest.raises(ValueError, match="stride"):
        windows.word_windows(rows, 4, 4)


def test_examples(spark):
    rows = labelled(spark, ["B-X", "I-X", "I-X", "O"])
    plain = items(spark, [0, 1, 2, 3])
    made = records.relabel(plain, rows).withColumn("strategy", F.lit("page_aware"))
    cuts = spark.createDataFrame([(1, "page_aware", 0, 0, [0, 1]), (1, "page_aware", 1, 2, [2, 3])], "doc_id bigint, strategy string, chunk_index int, word_start int, places array<int>")
    out = windows.examples(cuts, made, rows).orderBy("chunk_index", "k").collect()
    assert [r.label for r in out] == ["B-X", "I-X", "B-X", "O"] and all(r.box_mask == 1 for r in out)
    hidden = windows.examples(cuts, made, rows, hide_layout=("page_aware",)).collect()
    assert all(r.box_mask == 0 and r.page == -1 for r in hidden)


def predictions(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, record int, row_no int, position int, src int, gold string, pred string")


def test_votes(spark):
    rows = predictions(spark, [(1, 0, 0, 0, 0, "B-X", "B-X"), (1, 0, 1, 0, 0, "B-X", "O"), (1, 0, 2, 0, 1, "I-X", "I-X"), (1, 0, 2, 1, -1, None, "O")])
    voted = metrics.vote(rows)
    assert [tuple(r) for r in voted.orderBy("src").collect()] == [(1, 0, 0, "B-X", "B-X"), (1, 0, 1, "I-X", "I-X")]
    made = metrics.entity_metrics(voted).first()
    assert (made.n_gold_entities, made.entity_micro_f1) == (1, 1.0)
    with pytest.raises(Exception, match="differ"):
        metrics.vote(predictions(spark, [(1, 0, 0, 0, 0, "B-X", "O"), (1, 0, 1, 0, 0, "O", "O")])).collect()


def test_token_metrics_do_not_forgive(spark):
    voted = predictions(spark, [(1, 0, 0, 0, 0, "B-X", "I-X"), (1, 0, 0, 1, 1, "I-X", "I-X")]).select("doc_id", "record", "src", "gold", "pred")
    assert metrics.token_metrics(voted).first().accuracy == 0.5
    assert metrics.entity_metrics(voted).first().entity_micro_f1 == 1.0
    nothing = voted.limit(0)
    assert metrics.token_metrics(nothing).first().n_eval_tokens == 0 and metrics.entity_metrics(nothing).first().entity_micro_f1 == 0.0


def test_repair_breaks_at_gaps(spark):
    rows = predictions(spark, [(1, 0, 0, 0, s, "O", x) for s, x in ((0, "I-X"), (1, "I-X"), (3, "I-X"), (4, "Q-X"), (5, "I-Y"))])
    assert labels_of(metrics.repair(rows, "pred"), "src", "pred") == ["B-X", "I-X", "B-X", "O", "B-Y"]


def test_folds(spark):
    rows = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(40)], "doc_id bigint, stratum string")
    made = splits.folds(rows, k=4)
    assert made.groupBy("fold").agg(F.countDistinct("doc_id").alias("n")).where("n <> 40").count() == 0
    assert made.where("split = 'test'").groupBy("doc_id").count().where("count <> 1").count() == 0
    assert made.where("split = 'test'").groupBy("fold", "stratum").count().where("count <> 5").count() == 0
    assert {r.split: r.n for r in made.where("fold = 0").groupBy("split").agg(F.count("*").alias("n")).collect()} == {"test": 10, "train": 27, "validation": 3}
    with pytest.raises(Exception, match="fewer than"):
        splits.folds(rows.limit(2), k=4).collect()


def test_upsert(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 1)], "k string, j string, v int")
    new = spark.createDataFrame([("a", None, 2), ("c", "y", 3)], "k string, j string, v int")
    assert sorted((r.k, r.v) for r in results.upsert(old, new, ["k", "j"]).collect()) == [("a", 2), ("b", 1), ("c", 3)]
    assert results.upsert(old, old, ["none"]).count() == 2


def test_quality_without_annotations(spark):
    docs = spark.createDataFrame([(1, True), (2, False)], "doc_id bigint, has_annotations boolean")
    toks = tokens(spark, [(1, 0, "a", 0, 0, 0, 1, 1)])
    anns = annotations(spark, [(1, 0, "Agency", 0, 1, "a")])
    made = {r.doc_id: r for r in quality.by_document(docs, align.checks(toks, anns)).collect()}
    assert made[1].strict_match_rate == 1.0 and made[2].strict_match_rate == 1.0 and made[2].n_annotations == 0
    assert [r.label for r in quality.common_labels(docs, anns).collect()] == ["Agency"]
    assert [r.bio for r in quality.bio_label_map(anns.select("label")).orderBy("label_id").collect()] == ["O", "B-agency", "I-agency"]


def test_records_round_trip(spark, tmp_path):
    from folia.sources import readers

    rows = labelled(spark, ["B-X", "I-X", "O"])
    docs = spark.createDataFrame([(1, "set a")], "doc_id bigint, dataset_name string")
    made = records.relabel(serialize.page_aware(rows), rows)
    results.write_records(records.assemble(made, rows, docs, "page_aware"), str(tmp_path / "out"))
    back = readers.items_of(readers.records(spark, str(tmp_path / "out"), ["set a"], ["page_aware"]))
    want = made.select(F.col("doc_id").cast("string"), "pos", "text", "src", "role", "label")
    assert back.select(*want.columns).exceptAll(want).count() == 0 and back.count() == 4
    with pytest.raises(ValueError, match="no records"):
        readers.records(spark, str(tmp_path / "out"), ["other"])


def test_spans_end_at_ignored_tokens(spark):
    rows = tokens(spark, [(1, k, t, 5 * k, 0, 0, 1, 1, 0) for k, t in enumerate("abcdefg")])
    labels = ["B-X", "-100", "I-X", "X", "I-X", "Z-X", "I-X"]
    rows = rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.col("tok_idx") + 1)).withColumn("score", F.col("tok_idx") * 1.0)
    made = align.spans(rows, source="model").orderBy("token_start").collect()
    assert [(r.token_start, r.token_end, r.text, r.score, r.source) for r in made] == [(0, 0, "a", 0.0, "model"), (2, 2, "c", 2.0, "model"), (3, 4, "d e", 3.5, "model"), (6, 6, "g", 6.0, "model")]
    assert "score" not in align.spans(rows.drop("score")).columns
