"""Delivered rows as documents: the long tables of a data set in one step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.operators import documents, shred
from folia.sources import annotations, readers


@dataclass
class Documents:
    """docs (doc_id, dataset_name, text, has_annotations, source columns), tokens, blocks, and annotations or None."""

    docs: DataFrame
    tokens: DataFrame
    blocks: DataFrame
    annotations: DataFrame | None


def load(rows: DataFrame, dataset: str, training: bool = True, label_map: dict[str, str] | None = None, keep: list[str] | None = None, names: dict[str, list[str]] | None = None, wide: bool = False) -> Documents:
    """Rows of any delivered shape as documents of a data set.

    Columns are found by their candidate names. The id is the first of them, else the path of the OCR file, else
    ``<dataset>_unknown``; text is the delivered one, else the payload's own, else the pages' in order of number and text. Tokens are put in
    reading order and numbered, boxes on the scale of 0 .. 1 become pixels. A payload that can't be read gives a document without
    tokens. Without ``training`` there are no annotations. Rows must have one id each; null and empty columns are missing. docs have
    what is known of the source (split, folder, row, OCR path, images) as metadata. ``wide``: see shred.token_table.
    """
    if dataset not in (*readers.LOADABLE, *readers.LABEL_MAPS) and names is None:
        raise KeyError(f"no loader for {dataset!r}; there are {', '.join(readers.LOADABLE)}")
    rows, columns = readers.numbered(rows)
    present = {k: readers.first_present(columns, k, names) for k in readers.COLUMNS}
    sources = [F.col(columns[c]).cast("string").alias(c) for c in ("source_split", "source_folder", "source_row_index") if c in columns]
    doc_id = F.coalesce(present["doc_id"], present["ocr_path"], F.lit(f"{dataset}_unknown"))
    base = rows.select(doc_id.alias("raw_id"), *(present[k].alias(k) for k in ("text", "labels", "ocr_json", "ocr_path", "image_files")), *sources)
    payload = base.select("raw_id", "ocr_json", F.lit(None).cast("string").alias("ocr_output"), F.lit(None).cast("string").alias("ocr_data"))
    docs, tokens, blocks = _from_payloads(base.drop("labels", "ocr_json"), payload, dataset, training, wide)
    gold = None
    if training:
        aliases = S.LABEL_ALIASES | readers.LABEL_MAPS.get(dataset, {}) | (label_map or {})
        gold = annotations.label_spans(base.select("raw_id", "labels"), "raw_id", "labels", aliases, keep)
    return Documents(docs, tokens, blocks, gold)


def _from_payloads(base: DataFrame, payload: DataFrame, dataset: str, training: bool, wide: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, tokens, blocks) of base (raw_id, text, further columns for metadata) and payloads."""
    pages = shred.page_table(payload, wide)
    sizes = documents.page_sizes(pages)
    page_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n")
    texts = pages.where("text is not null and text <> ''").groupBy("raw_id").agg(page_text.alias("page_text"))
    own = shred.payload_table(payload, wide).select("raw_id", F.col("text").alias("own_text"))
    rest = [c for c in base.columns if c not in ("raw_id", "text")]
    metadata = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    docs = base.join(texts, "raw_id", "left").join(own, "raw_id", "left")
    docs = docs.select(F.col("raw_id").alias("doc_id"), F.lit(dataset).alias("dataset_name"), F.coalesce("text", "own_text", "page_text", F.lit("")).alias("text"), F.lit(training).alias("has_annotations"), metadata.alias("metadata"), *(c for c in ("ocr_path", "image_files") if c in rest))
    found = documents.to_pixels(shred.token_table(payload, wide), sizes)
    order = Window.partitionBy("raw_id").orderBy("page_no", "char_start", "y0", "x0", "char_end", "tok_no")
    tokens = found.select(F.col("raw_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("tok_idx"), F.coalesce("text", F.lit("")).alias("text"), "char_start", "char_end", F.col("page_no").alias("page"), "x0", "y0", "x1", "y1", "page_width", "page_height", F.lit(None).cast("bigint").alias("block_id"))
    blocks = documents.to_pixels(shred.block_table(payload, wide), sizes).select(F.col("raw_id").alias("doc_id"), "block_id", F.col("page_no").alias("page"), "char_start", "char_end", "text", "x0", "y0", "x1", "y1")
    return docs, tokens, blocks


def form_documents(rows: DataFrame, corpus: str, key: str = "filename", training: bool = True) -> Documents:
    """Rows (key, ocr, annotations) of ad_buy_form or registration_form as documents: form payloads under any of their names, and
    annotations of nested values on the text."""
    base = rows.select(F.col(key).cast("string").alias("raw_id"), F.lit(None).cast("string").alias("text"))
    payload = rows.select(F.col(key).cast("string").alias("raw_id"), F.col("ocr").alias("ocr_json"), F.lit(None).cast("string").alias("ocr_output"), F.lit(None).cast("string").alias("ocr_data"))
    docs, tokens, blocks = _from_payloads(base, payload, corpus, training, True)
    gold = None
    if training:
        texts = rows.select(F.col(key).cast("string").alias("doc_id"), "annotations").join(docs.select("doc_id", "text"), "doc_id")
        gold = annotations.nested_spans(texts, "doc_id", "annotations", "text", corpus)
    return Documents(docs, tokens, blocks, gold)


def entity_documents(exports: DataFrame, entities: DataFrame) -> Documents:
    """Box payloads (raw_id, ...) with entities (doc_id, entities map) as documents: entities that stand in the text are annotations."""
    docs, tokens = box_documents(exports)
    found = annotations.entity_spans(docs.join(entities, "doc_id"), "doc_id", "text", "entities").where("char_start is not null")
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end", "label")
    gold = found.withColumn("ann_idx", F.row_number().over(order) - 1)
    blocks = tokens.select("doc_id", "block_id", "page", "char_start", "char_end", "text", "x0", "y0", "x1", "y1")
    return Documents(docs.withColumns({"dataset_name": F.lit("multitype_docs"), "has_annotations": F.lit(True)}), tokens, blocks, gold)


def box_documents(exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, tokens) of box payloads: boxes in order of top and left, their texts as the lines of one text with running offsets;
    each box is a token and a block. Sides are rounded half to even; the page ends where the boxes do."""
    shaped = shred.payload_table(exports).where("shape = 'box'").select("raw_id")
    boxes = shred.token_table(exports).join(shaped, "raw_id", "left_semi")
    boxes = boxes.select(F.col("raw_id").alias("doc_id"), F.col("tok_no").alias("box_no"), F.trim("text").alias("text"), *(F.rint(s).cast("int").alias(s) for s in ("x0", "y0", "x1", "y1")))
    rows = documents.with_running_offsets(boxes)
    by = Window.partitionBy("doc_id")
    number = F.row_number().over(by.orderBy("y0", "x0", "box_no")) - 1
    tokens = rows.select("doc_id", number.alias("tok_idx"), "text", "char_start", "char_end", F.lit(0).alias("page"), "x0", "y0", "x1", "y1", F.max("x1").over(by).alias("page_width"), F.max("y1").over(by).alias("page_height"), number.alias("block_id"))
    parts = F.array_sort(F.collect_list(F.struct("tok_idx", "text")))
    docs = tokens.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return docs, tokens
