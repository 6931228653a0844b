"""Queries of the readers and loaders: tables are written as files of each kind and read again; and of single rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions import jsonvalues, scalars as S
from folia.operators import align, metrics, quality, records, results, serialize, splits, windows
from folia.plans import adapters
from folia.session import scratch_folder, table
from folia.sources import annotations as sources, loader, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Rows of a file of lines.
LINES = 500


@query
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """canon_docs as the CSV files of a data set, read back with their row numbers."""
    root = scratch_folder(spark, "csv")
    docs = table(spark, d, "canon_docs").join(adapters.docs(spark, d).select(F.col("doc_id").alias("rec_id"), F.col("split").alias("part")), "rec_id")
    for part in ("train", "val", "test"):
        rows = docs.where(F.col("part") == part).select("rec_id", "doc_id", "text", "lang").orderBy("rec_id").coalesce(1)
        rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/nda/{part}.csv")
    rows, _ = readers.csv_splits(spark, root, {"ndas": "nda"})
    return rows.select(F.col("rec_id").cast("bigint").alias("rec_id"), "dataset", "source_folder", "source_split", F.col("source_row_index").cast("bigint").alias("source_row_index"), F.coalesce("text", F.lit("")).alias("text"))


@query
def csv_status(spark: SparkSession, d: str) -> DataFrame:
    """What came of the files of each split, where only splits that documents have are there."""
    root = scratch_folder(spark, "csv")
    have = [r[0] for r in adapters.docs(spark, d).where("split <> 'val'").select("split").distinct().collect()]
    for part in have:
        table(spark, d, "region").coalesce(1).write.option("header", True).csv(f"{root}/nda/{part}.csv")
    return readers.csv_splits(spark, root, {"ndas": "nda"})[1].select("dataset", "source_split", F.substring("status", 1, 5).alias("status"))


def _line_files(docs: DataFrame) -> DataFrame:
    """(path, content): files of lines, gzipped in turn, lists in files and single records of canon_docs."""
    number = F.floor(F.col("rec_id") / LINES)
    value = F.to_json(F.struct("rec_id", "lang"), {"ignoreNullFields": "false"})
    parts = F.array_sort(F.collect_list(F.struct("rec_id", value.alias("v"))))
    joined = lambda by: F.array_join(F.transform("parts", lambda p: p["v"]), by)
    grouped = docs.groupBy(number.alias("n")).agg(parts.alias("parts"))
    name = F.concat(F.lit("set"), (F.col("n") % 3).cast("string"), F.lit("/f"), F.col("n").cast("string"))
    lines = F.when(F.col("n") % 3 == 0, F.concat(name, F.lit(".jsonl"))).when(F.col("n") % 3 == 1, F.concat(name, F.lit(".jsonl.gz")))
    return grouped.select(F.coalesce(lines, F.concat(name, F.lit(".json"))).alias("path"), F.when(lines.isNotNull(), joined("\n\n")).otherwise(F.concat(F.lit("["), joined(","), F.lit("]"))).alias("content"))


@query
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """canon_docs as a folder of JSON files, read back with the numbers of lines and of list entries."""
    root = scratch_folder(spark, "json")
    readers.write_texts(_line_files(table(spark, d, "canon_docs")), root)
    rows = readers.json_folder(spark, root)
    return rows.select(F.regexp_extract("source_path", r"([^/]+)$", 1).alias("file"), "source_line_number", F.get_json_object("value", "$.rec_id").cast("bigint").alias("rec_id"), F.get_json_object("value", "$.lang").alias("lang"))


@query
def payloads_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as files, gzipped or not, found by the path in a column; some paths have no file."""
    root = scratch_folder(spark, "payloads")
    rows = table(spark, d, "raw_exports").withColumn("content", F.coalesce("ocr_json", "ocr_output", "ocr_data"))
    odd = F.col("raw_id") % 2 == 1
    path = F.concat(F.lit("ocr/"), F.col("raw_id").cast("string"), F.when(odd, ".json.gz").otherwise(".json"))
    rows = rows.select("raw_id", path.alias("path"), "content")
    readers.write_texts(rows.where("content is not null"), root)
    made = readers.json_by_path(rows.select("raw_id", "path"), "path", root)
    return made.select("raw_id", F.length("payload").cast("bigint").alias("n_chars"), F.md5("payload").alias("digest"))


@query
def record_items(spark: SparkSession, d: str) -> DataFrame:
    """Records of two strategies written as JSON lines in folders, found, read and taken apart again."""
    root = scratch_folder(spark, "records")
    toks = adapters.tokens(spark, d)
    labelled = align.bio_labels(toks, adapters.annotations(toks))
    for name in ("page_aware", "plain_text"):
        made = records.assemble(records.relabel(serialize.strategy(name)(toks), labelled), toks, adapters.docs(spark, d), name)
        results.write_records(made, f"{root}/{name}", by=("dataset", "serializer"))
    rows = None
    for name in ("page_aware", "plain_text"):
        part = readers.items_of(readers.records(spark, f"{root}/{name}"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "strategy", "pos", "text", "src", "role", "label")


def _loaded(spark: SparkSession, d: str) -> loader.Documents:
    exports = table(spark, d, "raw_exports").select(F.col("raw_id").cast("string").alias("id"), F.coalesce("ocr_json", "ocr_output", "ocr_data").alias("OCR"), "labels", F.col("split").alias("source_split"))
    return loader.load(exports, "ndas")


@query
def loaded_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _loaded(spark, d).docs
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "dataset_name", "text", F.col("metadata")["source_split"].alias("source_split"))


@query
def loaded_tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = _loaded(spark, d).tokens
    return toks.select(F.col("doc_id").cast("bigint").alias("doc_id"), "tok_idx", "text", "char_start", "char_end", "page", "x0", "y0", "x1", "y1", "page_width", "page_height")


@query
def loaded_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = _loaded(spark, d).blocks
    return blocks.select(F.col("doc_id").cast("bigint").alias("doc_id"), "block_id", "page", "char_start", "char_end", "text", "x0", "y0", "x1", "y1")


@query
def box_tokens(spark: SparkSession, d: str) -> DataFrame:
    return loader.box_documents(table(spark, d, "raw_exports"))[1]


@query
def box_texts(spark: SparkSession, d: str) -> DataFrame:
    return loader.box_documents(table(spark, d, "raw_exports"))[0]


@query
def nested_values(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of nested values on canon_docs: a field with a span, a composite one whose value tells which, one that no value makes safe, an unknown one."""
    rows = table(spark, d, "canon_docs").where("text is not null and length(text) > 10").withColumn("n", (F.length("text") % 7 + 1).cast("string"))
    value = lambda field, text, start, end: F.concat(F.lit(f'["{field}", {{"a": [["{text}", [0, 0.1], [['), start, F.lit(", "), end, F.lit("]]]]}]"))
    fields = [value("gross_amount", "x", F.lit("0"), F.col("n")), value("Program Desc/Sub Amount", "$1,234.50", F.lit("2"), F.lit("5")), value("program_desc_channel", "y", F.lit("1"), F.lit("2")), value("unheard_of", "z", F.lit("1"), F.lit("2")), value("contract_num", "far", F.lit("9999999"), F.lit("10000000"))]
    rows = rows.select("rec_id", "text", F.concat(F.lit("["), F.concat_ws(", ", *fields), F.lit("]")).alias("annotations"))
    return sources.nested_spans(rows, "rec_id", "annotations", "text", "ad_buy_form").drop("value_no", "span_no")


@query
def first_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the first column that has any, of three."""
    rows = table(spark, d, "raw_exports").select("raw_id", F.when(F.col("raw_id") % 3 == 0, F.lit("[]")).otherwise(F.col("labels")).alias("a"), F.when(F.col("raw_id") % 2 == 0, F.lit(" ")).otherwise(F.col("labels")).alias("b"), F.lit("[1]").alias("c"))
    return sources.first_labels(rows, "raw_id", ["a", "b", "c"])


@query
def label_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Labels of exports kept, remapped or dropped, where those that fewer exports than half of the most have are dropped."""
    spans = sources.label_spans(table(spark, d, "raw_exports"), "raw_id")
    n = spans.groupBy("label").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).first()[0]
    keep = [r.label for r in n.collect() if 2 * r.n >= most]
    return sources.label_report(spans, keep)


@query
def invalid_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of exports that the made annotations don't have."""
    spans = sources.label_spans(table(spark, d, "raw_exports"), "raw_id")
    return sources.invalid_labels(spans, adapters.annotations(adapters.tokens(spark, d)).select("label"))


@query
def normal_values(spark: SparkSession, d: str) -> DataFrame:
    """JSON of orders with values in their extracted form."""
    shown = F.concat(F.lit("($ "), F.format_number("o_totalprice", 2), F.lit(")"))
    value = F.to_json(F.struct(shown.alias("gross_amount"), F.array(F.lit(" 1 May  2020"), F.col("o_orderdate").cast("date").cast("string")).alias("order_date"), F.concat(F.lit("  "), "o_orderpriority", F.lit(" – x ")).alias("who")))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("{broken")).otherwise(value).alias("v"))
    return jsonvalues.normal_json(rows, "o_orderkey", "v")


@query
def single_rules(spark: SparkSession, d: str) -> DataFrame:
    """Boxes back in pixels, exact matches, safe names, titles, markers and lists without repeats."""
    toks = adapters.tokens(spark, d)
    box = S.normal_box()
    label = F.when(F.col("tok_idx") % 2 == 0, "Gross Amount").otherwise("Agency")
    values = F.array(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 2, "a": 1}'), F.to_json(F.struct("tok_idx")), F.lit('{"tok_idx":0}'))
    return toks.select(
        "doc_id", "tok_idx", *(S.real_side(box[s], F.col("page_width" if s[0] == "x" else "page_height")).alias(f"p_{s}") for s in ("x0", "y0", "x1", "y1")), S.exact_match(label, F.col("text"), F.concat(F.lit(" "), "text", F.lit(" "))).alias("exact"),
        S.safe_name(F.col("text")).alias("name"), S.title_label(F.lit("total_amount DUE")).alias("title"), S.json_marker(F.lit('{"b": [1, null], "a": "x"}')).alias("marker"), F.size(S.unique_values(values)).alias("n_values"),
    )


@query
def best_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of the largest of three scores of each token, and the focal loss of its probability."""
    rows = adapters.tokens(spark, d).select("doc_id", "tok_idx", *(((F.col("doc_id") * a + F.col("tok_idx") * b) % 101 / 101.0).alias(c) for c, a, b in (("p", 7, 13), ("q", 11, 5), ("r", 3, 29))))
    best = metrics.best_label(F.array("p", "q", "r"), F.array(F.lit("O"), F.lit("B-a"), F.lit("I-a")))
    return rows.select("doc_id", "tok_idx", best.alias("label"), F.round(metrics.focal_loss((F.col("p") * 100 + 1) / 102), 6).alias("loss"))


@query
def item_label_ids(spark: SparkSession, d: str) -> DataFrame:
    toks = adapters.tokens(spark, d)
    anns = adapters.annotations(toks)
    items = records.relabel(serialize.page_aware(toks), align.bio_labels(toks, anns))
    return records.label_ids(items, quality.bio_label_map(anns.select("label"))).select("doc_id", "pos", "label_id")


@query
def positions(spark: SparkSession, d: str) -> DataFrame:
    """Items of the page strategy as a model's positions: pieces of each, the label at the first, cut at 128."""
    toks = adapters.tokens(spark, d)
    items = records.relabel(serialize.page_aware(toks), align.bio_labels(toks, adapters.annotations(toks)))
    rows = items.select("doc_id", F.col("pos").alias("k"), windows.piece_count(F.col("text")).alias("pieces"), "label", "src")
    made = windows.with_pieces(rows, ["doc_id"], 128)
    return made.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.count("label").alias("n_labelled"), F.count_if(F.col("src") >= 0).alias("n_first"))


@query
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    cut = windows.word_windows(serialize.page_aware(adapters.tokens(spark, d)), 64, 16)
    return windows.chunk_summary(cut)


@query
def page_features(spark: SparkSession, d: str) -> DataFrame:
    """What a layout model reads of each token: sides and page from 0 to 1."""
    toks = adapters.tokens(spark, d)
    rows = toks.select("doc_id", "tok_idx", "page", *(F.coalesce(v, F.lit(0)).alias(f"n_{k}") for k, v in S.normal_box().items()), F.when(S.normal_box()["x0"].isNotNull(), 1).otherwise(0).alias("box_mask"))
    return windows.layout_features(rows).select("doc_id", "tok_idx", *(F.round(f"f_{c}", 6).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1", "page")))


@query
def record_sources(spark: SparkSession, d: str) -> DataFrame:
    """Records with the split and the source of their documents."""
    docs = adapters.docs(spark, d)
    facts = docs.select(F.col("doc_id").alias("id"), F.col("dataset_name").alias("dataset"), F.coalesce("split", F.lit("none")).alias("split"), F.col("dataset_name").alias("source_folder"), F.col("split").alias("source_split"))
    made = records.with_sources(docs.select(F.col("doc_id").alias("id"), F.col("dataset_name").alias("dataset"), F.create_map(F.lit("kept"), F.lit("yes")).alias("metadata")), facts)
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return made.select("id", "dataset", "split", "source_folder", F.array_join(entries, ",").alias("metadata"))


@query
def record_slots(spark: SparkSession, d: str) -> DataFrame:
    """Which of the records under its key each is, by order of delivery; keys repeat within and across data sets."""
    rows = table(spark, d, "canon_docs").join(adapters.docs(spark, d).select(F.col("doc_id").alias("rec_id"), F.col("dataset_name").alias("dataset")), "rec_id")
    rows = rows.select("rec_id", "dataset", F.lit("page_aware").alias("serializer"), F.when(F.col("rec_id") % 4 == 0, F.lit("")).otherwise(F.col("doc_id")).alias("doc_key"), F.col("doc_id").alias("id"), F.lit("f").alias("source_path"), F.col("rec_id").alias("source_line_number"))
    return records.with_slots(rows).select("rec_id", "dataset", "doc_key", F.col("occurrence").cast("int").alias("occurrence"))


@query
def first_fold(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one split of a fold, where documents are dealt by data set."""
    docs = adapters.docs(spark, d)
    dealt = docs.select("doc_id").distinct().withColumns({"fold": F.lit(0), "split": F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")})
    return splits.fold_rows(docs, dealt, 0, "test").groupBy("dataset_name").agg(F.count("*").alias("n"))


@query
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    """Former runs by their largest mean number of subtokens, with their place."""
    rows = results.best_first(table(spark, d, "tokenization_summary").groupBy("strategy", "model_name").agg(F.round(F.avg("mean_subtokens"), 6).alias("mean")), "mean")
    return rows.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("mean"))))
