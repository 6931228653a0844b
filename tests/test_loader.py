import json

import pytest
from pyspark.sql import functions as F

from folia.config import ExperimentConfig
from folia.functions import jsonvalues
from folia.operators import windows
from folia.sources import loader

UNIT = {
    "pages": [{"page_num": 1, "text": "second"}, {"page_num": 0, "text": "Total $5", "size": {"width": 100, "height": 200}}],
    "tokens": [{"text": "$5", "doc_offset": {"start": 6, "end": 8}, "position": {"x0": 30, "y0": 1, "x1": 40, "y1": 9}}, {"text": "Total", "doc_offset": {"start": 0, "end": 5}, "position": {"x0": 0.5, "y0": 0.5, "x1": 0.75, "y1": 1}}],
    "blocks": [{"text": "Total $5", "doc_offset": {"start": 0, "end": 8}, "position": {"left": 0, "top": 0, "right": 50, "bottom": 10}}],
}


def test_load(spark):
    rows = spark.createDataFrame([("a.pdf", None, json.dumps(UNIT), repr([{"label": "Line Item - Start Data", "start": 6, "end": 8, "text": "$5"}]), "p"), ("", "own text", "broken", None, "b.json")], "filename string, text string, OCR string, labels string, ocr string")
    made = loader.load(rows, "ndas")
    docs = {r.doc_id: r for r in made.docs.collect()}
    assert docs["a.pdf"].text == "Total $5\n\nsecond" and docs["b.json"].text == "own text"
    tokens = made.tokens.orderBy("tok_idx").collect()
    assert [(t.text, t.x0, t.y1, t.page_width) for t in tokens] == [("Total", 50, 200, 100.0), ("$5", 30, 9, 100.0)]
    assert made.blocks.first().block_id == 0 and made.annotations.first().label == "Line Item - Start Date"
    assert loader.load(rows, "ndas", training=False).annotations is None
    assert loader.load(rows.limit(0), "ndas").tokens.count() == 0


def test_box_documents(spark):
    box = {"ocr_boxes": [{"text": "low", "points": [[0, 50], [9, 50], [9, 60], [0, 60]]}, {"text": "high", "points": [[5, 1], [9, 1], [9, 8.5], [5, 8.5]]}]}
    exports = spark.createDataFrame([(1, json.dumps(box), None, None)], "raw_id bigint, ocr_json string, ocr_output string, ocr_data string")
    docs, tokens = loader.box_documents(exports)
    assert docs.first().text == "high\nlow"
    assert [(t.text, t.char_start, t.char_end, t.y1, t.page_height) for t in tokens.orderBy("tok_idx").collect()] == [("high", 0, 4, 8, 60), ("low", 5, 8, 60, 60)]


def test_json_values(spark):
    value = {"Total": ["($1,234.50)", "$5P-2"], "start_date": "1 May  2020", "name": " a – b ", "none": None, "deep": {"rate": 5}}
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, "x"), (3, None)], "k int, j string")
    made = {r.k: r.value for r in jsonvalues.normal_json(rows, "k", "j").collect()}
    assert json.loads(made[1]) == {"Total": ["-1234.50", "5"], "start_date": "1May2020", "name": "a - b", "none": "", "deep": {"rate": "5"}} and made[2] is None and made[3] is None


def test_pieces_and_summary(spark):
    rows = spark.createDataFrame([(1, 0, 2, "B-a", 0), (1, 1, 1, None, -1), (1, 2, 3, "O", 1)], "doc_id int, k int, pieces int, label string, src int")
    made = windows.with_pieces(rows, ["doc_id"], max_length=7).orderBy("position").collect()
    assert [(r.position, r.label, r.src) for r in made] == [(1, "B-a", 0), (2, None, -1), (3, None, -1), (4, "O", 1), (5, None, -1)]
    cuts = spark.createDataFrame([(1, 0, 4), (1, 3, 5)], "doc_id int, word_start int, word_end int")
    assert tuple(windows.chunk_summary(cuts).first()) == (2, 1, 3.0, 4)
    items = spark.createDataFrame([(1, 0, 2, "I-a"), (1, 1, None, None), (1, 2, 0, "B-a")], "doc_id int, pos int, src int, label string")
    assert [r.label for r in windows.canonical_labels(items).orderBy("tok_idx").collect()] == ["B-a", "O", "B-a"]


def test_config():
    made = ExperimentConfig().with_settings(["N-FOLDS=3", 'strategies=["a"]', "mode=x"])
    assert made.n_folds == 3 and made.strategies == ("a",) and made.extra == {"mode": "x"}
    with pytest.raises(ValueError):
        ExperimentConfig(n_folds=1)
    old = ExperimentConfig().with_settings(["DATASETS_TO_RUN=all", "STRATEGIES_TO_RUN=plain_text, page_aware", "SAMPLING=5", "VALIDATION_FRACTION_OF_TRAIN=0.2"])
    assert old.datasets == () and old.strategies == ("plain_text", "page_aware") and old.sample_docs == 5 and old.validation_fraction == 0.2
    assert windows.effective_length(512, None) == windows.effective_length(512, 10**30) == 512 and windows.effective_length(512, 128) == 128


def test_command_line(spark, data, tmp_path, capsys):
    from folia.__main__ import main

    main(["queries"])
    assert "p3_found" in capsys.readouterr().out
    main(["serialize", "--data", data, "--out", str(tmp_path / "r"), "--strategies", "plain_text", "page_aware"])
    main(["plan", "--records", str(tmp_path / "r"), "--out", str(tmp_path / "p"), "--set", "n_folds=2"])
    assert spark.read.parquet(str(tmp_path / "p" / "folds")).groupBy("fold").count().count() == 2
    plan = spark.read.parquet(str(tmp_path / "p" / "windows"))
    assert spark.read.parquet(str(tmp_path / "p" / "tokenization_summary")).agg(F.sum("n_docs")).first()[0] > 0
    assert plan.groupBy("strategy").agg(F.count("*").alias("n")).select("n").distinct().count() == 1
