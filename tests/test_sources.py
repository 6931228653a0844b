import gzip
import json

import pytest
from pyspark.sql import functions as F

from folia.sources import annotations as A
from folia.sources import readers as R


def test_csv_splits(spark, tmp_path):
    folder = tmp_path / "nda"
    folder.mkdir()
    (folder / "train.csv").write_text('id,text\n1,"two\nlines, ""q"""\n2,b\n')
    (folder / "val.csv").write_text("id,text,labels\n3,c,[]\n")
    rows, status = R.csv_splits(spark, str(tmp_path), {"ndas": "nda"})
    assert sorted((r.id, r.source_split, r.source_row_index) for r in rows.collect()) == [("1", "train", 0), ("2", "train", 1), ("3", "val", 0)]
    assert rows.where("id = 1").first().text == 'two\nlines, "q"'
    assert {r.source_split: r.status[:5] for r in status.collect()} == {"train": "ok", "val": "ok", "test": "error"}


def test_json_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('{"id": 1}')
    (tmp_path / "a" / "list.json").write_text('[{"id": 2}, {"id": 3}]')
    with gzip.open(tmp_path / "lines.jsonl.gz", "wt") as file:
        file.write('{"id": 4}\n\n{"id": 5}\n')
    rows = [(r.source_path.rsplit("/", 1)[1], r.source_line_number, json.loads(r.value)["id"]) for r in R.json_folder(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=lambda r: r[2]) == [("one.json", None, 1), ("list.json", 0, 2), ("list.json", 1, 3), ("lines.jsonl.gz", 1, 4), ("lines.jsonl.gz", 3, 5)]
    assert sorted((r.line_no, r.value) for r in R.json_lines(spark, str(tmp_path / "lines.jsonl.gz")).collect()) == [(1, '{"id": 4}'), (3, '{"id": 5}')]
    paths = spark.createDataFrame([(1, "a/one.json"), (2, "none.json"), (3, None)], "k int, p string")
    assert {r.k: r.payload for r in R.json_by_path(paths, "p", str(tmp_path)).collect()} == {1: '{"id": 1}', 2: None, 3: None}
    (tmp_path / "a" / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match=r"malformed JSON in .*bad\.jsonl:1"):
        R.json_folder(spark, str(tmp_path)).collect()


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """Line numbers go on over the splits of a plain file, blank lines and line ends of both kinds among them."""
    with open(tmp_path / "big.jsonl", "w", newline="") as file:
        file.write("".join(f'{{"k": {k}}}' + ("\r\n" if k % 3 else "\n\n") for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        made = R.json_lines(spark, str(tmp_path / "big.jsonl"))
        rows = made.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    lines = (tmp_path / "big.jsonl").read_bytes().decode().split("\n")
    assert len(rows) == 5000 and all(lines[r.line_no - 1].strip() == r.value for r in rows)


def test_records_round_trip(spark, tmp_path):
    base = {"id": "d", "tokens": ["[PAGE_0]", "a", "b"], "labels": ["-100", "B-x", "O"], "item_attrs": [{"page": "0"}, {}, {}], "original_token_labels": ["B-x", "O"], "metadata": {"corpus": "c"}, "doc_key": "c::d"}
    for dataset, strategy, record in (("one", "page_aware", base | {"source_token_indices": [None, 0, 1], "layout_roles": ["page", "ocr_token", "ocr_token"]}), ("two", "page_aware", base), ("two", "plain_text", base)):
        folder = tmp_path / "r" / dataset / strategy
        folder.mkdir(parents=True)
        (folder / "all.jsonl").write_text(json.dumps(record) + "\n\n")
    root = str(tmp_path / "r")
    assert [p[:2] for p in R.record_folders(spark, root)] == [("one", "page_aware"), ("two", "page_aware"), ("two", "plain_text")]
    rows = R.records(spark, root, ["one", "two"], ["page_aware", "none"])
    got = {r.dataset: r for r in rows.collect()}
    assert set(got) == {"one", "two"} and got["one"].item_attrs[0] == {"page": "0"} and got["one"].metadata == {"corpus": "c"} and got["two"].original_token_labels == ["B-x", "O"]
    items = sorted((r.strategy, r.pos, r.text, r.src, r.role, r.label) for r in R.items_of(R.records(spark, root, ["one"])).collect())
    assert items == [("page_aware", 0, "[PAGE_0]", None, "page", None), ("page_aware", 1, "a", 0, "ocr_token", "B-x"), ("page_aware", 2, "b", 1, "ocr_token", "O")]
    old = sorted((r.pos, r.src, r.role, r.label) for r in R.items_of(R.records(spark, root, ["two"], ["plain_text"])).collect())
    assert old == [(0, None, "layout", None), (1, 0, "ocr_token", "B-x"), (2, 1, "ocr_token", "O")]
    with pytest.raises(ValueError, match="three"):
        R.records(spark, root, ["three"])
    (tmp_path / "r" / "one" / "page_aware" / "all.jsonl").write_text('{"id": "x"}\n{"id": \n')
    with pytest.raises(Exception, match=r"all\.jsonl:2"):
        R.records(spark, root, ["one"]).collect()


def test_first_present(spark):
    rows = spark.createDataFrame([(None, "x", "NaN"), ("", "y", "z")], "id string, filename string, doc_id string")
    rows, columns = R.numbered(rows)
    assert [r[0] for r in rows.select(R.first_present(columns, "doc_id")).collect()] == ["x", "z"]
    assert rows.select(R.first_present(columns, "labels")).first()[0] is None


def test_parse_json_like():
    assert A.parse_json_like('{"a": null}') == {"a": None} and A.parse_json_like("{'a': None}") == {"a": None}
    assert A.parse_json_like("  x ") == "x" and A.parse_json_like(" ") is None and A.parse_json_like(None) is None and A.parse_json_like(b"[1]") == [1]


def test_label_spans(spark):
    labels = [
        (1, json.dumps([{"label": "Line Item - Start Data", "start": "9", "end": 12}, {"label": " A  b ", "start": 1, "end": 2, "text": "t"}])),
        (2, "{'labels': [{'label': 'x', 'start': None, 'end': 2}, {'label': '', 'start': 1, 'end': 2}, 5]}"), (3, "broken ["), (4, None), (5, ""),
    ]
    rows = A.label_spans(spark.createDataFrame(labels, "k bigint, labels string"), "k")
    assert [tuple(r) for r in rows.orderBy("ann_idx").collect()] == [(1, 0, "A b", "A  b", 1, 2, "t"), (1, 1, "Line Item - Start Date", "Line Item - Start Data", 9, 12, "")]
    assert {r.status: r.n for r in A.label_report(rows).collect()} == {"kept": 1, "remapped": 1}
    assert A.label_spans(spark.createDataFrame([], "k bigint, labels string"), "k").count() == 0


def test_nested_spans(spark):
    doc = "Total 3712 due"
    fields = [["gross_amount", [["3712\n", [0, 0.4, 0.3, 0.5, 0.3], [[6, 10]]]]], ["program_desc_sub_amount", {"a": [["$1,234.50", [0], [[90, 99]]], ["news", [0], [[0, 5]]]]}], ["unknown", [["x", [0], [[0, 1]]]]]]
    rows = spark.createDataFrame([(1, json.dumps(fields), doc)], "k bigint, a string, t string")
    made = [(r.label, r.char_start, r.text) for r in A.nested_spans(rows, "k", "a", "t", "ad_buy_form").orderBy("ann_idx").collect()]
    assert made == [("gross_amount", 6, "3712"), ("sub_amount", 90, "$1,234.50")]
    other = spark.createDataFrame([(1, json.dumps([["signer_name", [["Bo", [0], [[0, 5]]]]], ["new_field", []]]), doc)], "k bigint, a string, t string")
    assert [(r.label, r.text) for r in A.nested_spans(other, "k", "a", "t", "registration_form").collect()] == [("Signer Name", "Total")]


def test_ad_buy_labels():
    assert A.ad_buy_label("Contract Num", "") == "contract_number" and A.ad_buy_label("B-channel", "") == "channel"
    assert A.ad_buy_label("program_start_date_channel", "1/2/2020") == "program_start_date" and A.ad_buy_label("program_start_date_channel", "x") is None
    assert A.ad_buy_label("program_start_date_program_end_date", "1/2/2020") is None and A.ad_buy_label("other", "") is None


def test_entity_spans(spark):
    text = "Pay  to:\n 12 Main   Street, RM 14.10 (a.b*)"
    values = {"exact": "Main", "spaced": "12 Main Street,", "number": "14.10", "special": "(a.b*)", "none": "lane", "empty": "", "blank": "   "}
    rows = spark.createDataFrame([(1, text, values)], "k bigint, t string, e map<string,string>")
    made = {r.raw_label: (r.match_status, r.text) for r in A.entity_spans(rows, "k", "t", "e").collect()}
    assert made["exact"] == ("exact", "Main") and made["spaced"] == ("whitespace_normalized", "12 Main   Street,") and made["number"] == ("exact", "14.10")
    assert made["special"] == ("exact", "(a.b*)") and made["none"] == ("not_found", "lane") and made["empty"] == ("empty_value", "") and made["blank"][0] in ("exact", "not_found")


def test_stream(spark, tmp_path):
    from folia.streaming.ingest import serialize_stream

    schema = "rec_id bigint, tok_idx int, text string, char_start int, char_end int, page int, x0 int, y0 int, x1 int, y1 int, page_width int, page_height int, block_id int, loaded_at int"
    rows = [(d, k, f"w{k}", 3 * k, 3 * k + 2, 0, 1, 1, 2, 2, 10, 10, 0, 1) for d in (1, 2) for k in range(3)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    docs = lambda b: b.select(F.col("rec_id").alias("doc_id"), F.lit("set").alias("dataset_name")).distinct()
    serialize_stream(stream, docs, str(tmp_path / "out"), str(tmp_path / "check"), ["page_aware", "plain_text"]).awaitTermination()
    made = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.id, r.strategy, len(r.tokens)) for r in made.collect()) == [(1, "page_aware", 4), (1, "plain_text", 3), (2, "page_aware", 4), (2, "plain_text", 3)]
