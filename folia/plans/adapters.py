"""Documents for the engine's own queries, made from the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.operators import documents
from folia.session import table

# Labels that the made annotations take in turn.
LABELS = ["Gross Amount", "Invoice Date", "Agency", "Line Item - Rate", "Line Item - Start Data", "Advertiser & Client", "Account Total"]


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return documents.clean_tokens(table(spark, d, "ocr_tokens"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, dataset_name, split, has_annotations) of canon_docs, in one spelling."""
    name = F.regexp_replace(F.lower(F.trim("dataset_name")), r"[\s-]", "_")
    split = F.lower(F.trim("split"))
    split = F.when(split == "training", "train").when(split.isin("validation", "dev"), "val").otherwise(split)
    return table(spark, d, "canon_docs").select(F.col("rec_id").alias("doc_id"), name.alias("dataset_name"), split.alias("split"), "has_annotations")


def annotations(toks: DataFrame) -> DataFrame:
    """Spans over one to three tokens at every ninth place, some of them overlapping, some beyond the text, some of
    another text: gold for tokens that have none, the same rows for the same tokens."""
    by = Window.partitionBy("doc_id").orderBy("tok_idx")
    k = (F.col("doc_id") + F.col("tok_idx")) % 3
    nxt = {f"{c}{n}": F.lead(c, n).over(by) for c in ("text", "char_end") for n in (1, 2)}
    rows = toks.withColumns(nxt).where((F.col("tok_idx") % 9 == 2) | ((F.col("doc_id") % 4 == 0) & (F.col("tok_idx") % 9 == 3)))
    end = F.when((k == 1) & F.col("char_end1").isNotNull(), F.col("char_end1")).when((k == 2) & F.col("char_end2").isNotNull(), F.col("char_end2")).otherwise(F.col("char_end"))
    text = F.when((k == 1) & F.col("text1").isNotNull(), F.concat_ws(" ", "text", "text1")).when((k == 2) & F.col("text2").isNotNull(), F.concat_ws(" ", "text", "text1", "text2")).otherwise(F.col("text"))
    text = F.when(F.col("tok_idx") % 7 == 0, "another text").when(F.col("tok_idx") % 5 == 0, F.concat(text, F.lit("P-2"))).otherwise(text)
    shift = F.when((F.col("doc_id") % 10 == 0) & (F.col("tok_idx") % 2 == 0), 1_000_000).otherwise(0)
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("doc_id") + F.col("tok_idx")) % len(LABELS) + 1).cast("int"))
    return rows.select("doc_id", F.col("tok_idx").alias("ann_idx"), label.alias("label"), (F.col("char_start") + shift).alias("char_start"), (end + shift).alias("char_end"), text.alias("text"))


def blocks(toks: DataFrame) -> DataFrame:
    """Blocks of twelve tokens of a page, so that tokens without block_id lie in one."""
    key = (F.col("tok_idx") / 12).cast("int")
    return toks.groupBy("doc_id", "page", key.alias("block_id")).agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def predictions(labelled: DataFrame) -> DataFrame:
    """Predicted labels for windows of 64 tokens that overlap by 16: gold, but for made errors."""
    first = F.greatest(F.lit(0), F.floor((F.col("tok_idx") - 64) / 48) + 1).cast("int")
    rows = labelled.select("doc_id", "tok_idx", "label", F.explode(F.sequence(first, F.floor(F.col("tok_idx") / 48).cast("int"))).alias("row_no"))
    e = (F.col("doc_id") * 7919 + F.col("tok_idx") * 104729 + F.col("row_no") * 31) % 10
    pred = F.when(e == 0, "O").when((e == 1) & F.startswith("label", F.lit("B-")), F.concat(F.lit("I-"), F.substring("label", 3, 100))).when((e == 2) & (F.col("label") == "O"), "B-agency").otherwise(F.col("label"))
    return rows.select("doc_id", F.lit(0).alias("record"), "row_no", F.col("tok_idx").alias("position"), F.col("tok_idx").alias("src"), F.col("label").alias("gold"), pred.alias("pred"))
