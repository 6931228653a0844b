"""Attributes, sources and ids of records; payloads under other names; documents of forms and boxes; tokenizer pieces."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folia.operators import records, results, serialize, shred, windows
from folia.sources import annotations, loader

TOKEN = "doc_id bigint, tok_idx int, text string, char_start int, char_end int, page int, x0 int, y0 int, x1 int, y1 int, page_width int, page_height int, block_id int, label string"


def page(spark):
    words = [("Name:", 10, 10), ("Alice", 100, 10), ("Address:", 10, 60), ("Main", 12, 100), ("plain", 10, 200)]
    return spark.createDataFrame([(1, k, t, 10 * k, 10 * k + 5, 0, x, y, x + 60, y + 20, 1000, 1000, None, "B-a" if k == 1 else "O") for k, (t, x, y) in enumerate(words)], TOKEN)


def test_attributes_and_original_labels(spark):
    toks = page(spark)
    items = serialize.strategy("key_value_anchor_pairs", attrs=True)(toks)
    fields = {r.text: r.attrs for r in items.where("role = 'field'").collect()}
    assert fields["[FIELD_0]"] == {"page": "0", "pair_id": "0", "orientation": "right"} and fields["[FIELD_1]"]["orientation"] == "below"
    plain = serialize.strategy("key_value_anchor_pairs")(toks)
    assert plain.columns == ["doc_id", "pos", "text", "src", "role"] and plain.where("src < 0").count() == 0
    docs = spark.createDataFrame([(1, "set", "key", {"a": "b"})], "doc_id bigint, dataset_name string, doc_key string, metadata map<string,string>")
    made = records.assemble(records.relabel(items, toks), toks, docs, "key_value_anchor_pairs", toks).first()
    assert made.doc_key == "key" and made.metadata == {"a": "b"} and list(made.original_token_labels) == ["O", "B-a", "O", "O", "O"]
    assert made.item_attrs[0] == {"page": "0"} and {a.get("pair_id") for a in made.item_attrs if "pair_id" in a} == {"0", "1"}
    assert records.assemble(plain, toks, docs.select("doc_id", "dataset_name"), "x").first().item_attrs[0] == {"page": "0"}


def test_label_ids(spark):
    items = spark.createDataFrame([(1, 0, None, None), (1, 1, 0, "B-a"), (1, 2, 1, "O")], "doc_id int, pos int, src int, label string")
    ids = spark.createDataFrame([(0, "O"), (1, "B-a")], "label_id int, bio string")
    assert [r.label_id for r in records.label_ids(items, ids).orderBy("pos").collect()] == [-100, 1, 0]
    with pytest.raises(Exception, match="no id for label B-a"):
        records.label_ids(items, ids.where("label_id = 0")).collect()


def test_keys_and_slots(spark):
    rows = [("s", "p", None, "", "d1", {"doc_key": "m"}, "f", 1), ("s", "p", None, None, None, {"original_filename": "o"}, "f", 2), ("s", "p", None, None, None, {}, "f", 3), ("s", "p", "k", "i", None, None, "f", 4), ("s", "p", "k", None, None, None, "f", 5)]
    made = records.with_slots(spark.createDataFrame(rows, "dataset string, serializer string, doc_key string, id string, doc_id string, metadata map<string,string>, source_path string, source_line_number int"))
    assert sorted((r.source_line_number, r.doc_key, r.occurrence) for r in made.collect()) == [(1, "d1", 0), (2, "o", 0), (3, "f::fallback::3", 0), (4, "k", 0), (5, "k", 1)]


def test_features_and_seconds(spark):
    rows = spark.createDataFrame([(0, 1200, 500, -5, 1, 3), (1, 2, 3, 4, 0, -1), (1, 2, 3, 4, 1, 999)], "n_x0 int, n_y0 int, n_x1 int, n_y1 int, box_mask int, page int")
    made = windows.layout_features(rows).collect()
    assert (made[0].f_x0, made[0].f_y0, made[0].f_x1, made[0].f_y1, made[0].f_page) == (0.0, 1.0, 0.5, 0.0, 4 / 256)
    assert made[1].f_x1 == 0 and made[1].f_page == 0 and made[2].f_page == 1.0
    seconds = results.timed({"a": rows, "b": rows.limit(1)}).collect()
    assert [r.strategy for r in seconds] == ["a", "b"] and all(r.seconds > 0 for r in seconds)


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="no vocabulary files")
def test_pieces_of_a_tokenizer(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    texts = ["Total", "supercalifragilistic", "", None, "[PAGE_0]", "Total"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    public = Tokenizer.from_file(path)
    made = {r.k: r.pieces for r in windows.tokenizer_pieces(rows, path).collect()}
    assert made == {k: max(1, len(public.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}
    assert windows.tokenizer_pieces(rows.limit(0), path).count() == 0


def exports(spark, *payloads):
    return spark.createDataFrame([(k, json.dumps(p) if not isinstance(p, str) else p, None, None) for k, p in enumerate(payloads)], "raw_id bigint, ocr_json string, ocr_output string, ocr_data string")


FORM = {
    "text": "whole",
    "pages": [
        {"pageNumber": "x", "page_index": 4, "size": {"width": 0, "height": 50}, "page_width": 200, "tokens": [
            {"text": "a", "text_offset": {"start": 0, "end": 1}, "bounding_box": {"x": 1, "y": 2, "width": 3, "height": 4}},
            {"text": "b", "offset": {"start": 2, "end": 3}, "position": {"left": 1, "y0": 2, "x1": 9, "bottom": 8}},
            {"text": "c", "segments": [[4, 5]], "bbox": [0, 0.1, 0.2, 0.3, 0.4]},
            {"text": "d", "offset": {"start": 6}, "bbox": [1, 2, 3, 4]},
        ], "lines": [{"text": "a b", "offset": {"start": 0, "end": 3}, "boundingBox": [0, 0, 9, 9]}]},
        {"tokens": []},
    ],
}


def test_other_names_of_pages_ranges_and_boxes(spark):
    rows = exports(spark, FORM)
    assert [(r.text, r.page_no, r.char_start, r.char_end, r.x0, r.y0, r.x1, r.y1, r.block_id) for r in shred.token_table(rows, wide=True).orderBy("tok_no").collect()] == [("a", 4, 0, 1, 1, 2, 4, 6, 0), ("b", 4, 2, 3, 1, 2, 9, 8, 0), ("c", 4, 4, 5, 0.1, 0.2, 0.3, 0.4, -1)]
    assert [(r.page_no, r.page_width, r.page_height) for r in shred.page_table(rows, wide=True).orderBy("page_no").collect()] == [(1, None, None), (4, 200.0, 50.0)]
    assert [(r.text, r.page_no) for r in shred.token_table(rows).collect()] == [("c", 0)]
    assert tuple(shred.payload_table(rows, wide=True).first())[1:] == ("form", "whole", 2, 3, 1)
    odd = exports(spark, "null", "[]", "3", '"x"', "{}", "broken {", {"ocr_boxes": []})
    assert sorted((r.raw_id, r.shape) for r in shred.payload_table(odd).collect()) == [(1, "unit"), (4, "other"), (6, "box")]
    assert shred.payload_table(odd.limit(0)).count() == 0


def test_form_documents(spark):
    rows = spark.createDataFrame([("f.pdf", json.dumps(FORM), json.dumps([["gross_amount", [["ole", [0], [[2, 5]]]]]]))], "filename string, ocr string, annotations string")
    made = loader.form_documents(rows, "ad_buy_form")
    assert made.docs.first().text == "whole" and [t.text for t in made.tokens.orderBy("tok_idx").collect()] == ["a", "b", "c"]
    assert [(r.x0, r.y1) for r in made.tokens.where("text = 'c'").collect()] == [(20, 20)]
    assert [(r.label, r.text) for r in made.annotations.collect()] == [("gross_amount", "ole")]
    assert loader.form_documents(rows, "ad_buy_form", training=False).annotations is None


def test_entity_documents(spark):
    box = {"ocr_boxes": [{"text": "TOTAL 14.10", "points": [[0, 50], [9, 50], [9, 60], [0, 60]]}, {"text": "Shop", "points": [[5, 1], [9, 1], [9, 8], [5, 8]]}]}
    unit = {"tokens": [{"text": "x", "doc_offset": {"start": 0, "end": 0}, "position": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}}], "blocks": []}
    entities = spark.createDataFrame([(0, {"total": "14.10", "company": "Shop", "date": "none"})], "doc_id bigint, entities map<string,string>")
    made = loader.entity_documents(exports(spark, box, unit), entities)
    assert [(r.ann_idx, r.label, r.text, r.char_start) for r in made.annotations.orderBy("ann_idx").collect()] == [(0, "Company", "Shop", 0), (1, "Total", "14.10", 11)]
    assert made.tokens.count() == 2 and made.docs.count() == 1 and made.blocks.count() == 2


def test_label_reports(spark):
    rows = spark.createDataFrame([(1, json.dumps([{"label": "a", "start": "x", "end": 2}, {"label": "b", "start": 1, "end": 2}, {"label": "c"}]))], "k bigint, labels string")
    assert [r.label for r in annotations.label_spans(rows, "k").collect()] == ["b"]
    with pytest.raises(Exception, match="no whole numbers"):
        annotations.label_spans(rows, "k", strict=True).collect()
    spans = annotations.label_spans(rows, "k")
    assert [(r.label, r.status) for r in annotations.label_report(spans, keep=["z"]).collect()] == [("b", "dropped")]
    assert annotations.invalid_labels(spans, spark.createDataFrame([("b",)], "label string")).count() == 0


def test_loader_of_an_unknown_data_set(spark):
    rows = spark.createDataFrame([("a", "t")], "id string, text string")
    with pytest.raises(KeyError, match="resource_contracts"):
        loader.load(rows, "unknown")
    assert loader.load(rows, "sec_s1").docs.first().dataset_name == "sec_s1"
    made = loader.load(rows.withColumns({"source_split": F.lit("train"), "source_row_index": F.lit(3)}), "ndas").docs.first()
    assert made.metadata == {"source_split": "train", "source_row_index": "3"}
