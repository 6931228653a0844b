"""Quality of annotations, and statistics of labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S

_RATES = {"token_available_rate": "n_tokens > 0", "strict_match_rate": "strict_match", "loose_value_match_rate": "loose_match"}


def _rates() -> list:
    return [F.round(F.avg(F.expr(c).cast("int")), 6).alias(k) for k, c in _RATES.items()]


def by_document(docs: DataFrame, checked: DataFrame) -> DataFrame:
    """One row per document of docs (doc_id): its annotations, the rates of their checks (1 without any), and the numbers that fail."""
    found = checked.groupBy("doc_id").agg(F.count("*").alias("n_annotations"), *_rates(), F.count_if(F.col("n_tokens") == 0).alias("n_unavailable"), F.count_if((F.col("n_tokens") > 0) & ~F.col("loose_match")).alias("n_loose_mismatch"))
    rows = docs.select("doc_id").distinct().join(found, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_annotations", "n_unavailable", "n_loose_mismatch")}
    return rows.withColumns(zero | {k: F.coalesce(k, F.lit(1.0)) for k in _RATES})


def by_label(checked: DataFrame) -> DataFrame:
    """Rates of the checks for each label, the worst first."""
    return checked.groupBy("label").agg(F.count("*").alias("n"), *_rates()).orderBy("token_available_rate", "loose_value_match_rate", "label")


def kept_for_training(checked: DataFrame, drop_unavailable: bool = True, drop_mismatch: bool = False) -> DataFrame:
    """The annotations that a quality policy keeps."""
    keep = F.lit(True)
    if drop_unavailable:
        keep = keep & (F.col("n_tokens") > 0)
    if drop_mismatch:
        keep = keep & ((F.col("n_tokens") == 0) | F.col("loose_match"))
    return checked.where(keep)


def gold_spans(checked: DataFrame, with_unavailable: bool = False) -> DataFrame:
    """Gold records with both texts in their extracted form."""
    rows = checked if with_unavailable else checked.where("n_tokens > 0")
    return rows.withColumns({"normalized_gold": S.extracted_form(F.col("label"), F.col("text")), "normalized_token": S.extracted_form(F.col("label"), F.col("token_text"))})


def label_counts(annotations: DataFrame) -> DataFrame:
    """(label, n_annotations, n_documents)."""
    return annotations.groupBy("label").agg(F.count("*").alias("n_annotations"), F.countDistinct("doc_id").alias("n_documents"))


def labels_of_documents(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))


def _annotated(docs: DataFrame) -> DataFrame:
    return docs.where("has_annotations").agg(F.count("*").alias("n_docs"))


def common_labels(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(label): those of every annotated document; docs (doc_id, has_annotations)."""
    return label_counts(annotations).crossJoin(_annotated(docs)).where("n_documents = n_docs").select("label")


def labels_by_frequency(docs: DataFrame, annotations: DataFrame, least: float | int) -> DataFrame:
    """(label): those of at least ``least`` annotated documents, a part of them if a float (rounded up)."""
    if isinstance(least, float):
        if not 0 < least <= 1:
            raise ValueError("a part must be above 0 and at most 1")
        threshold = F.floor(F.col("n_docs") * F.lit(least) + F.lit(0.999999))
    else:
        threshold = F.lit(math.floor(least))
    return label_counts(annotations).crossJoin(_annotated(docs)).where(F.col("n_documents") >= threshold).select("label")


def bio_label_map(labels: DataFrame) -> DataFrame:
    """labels (label) -> (label_id, bio): O, then B and I of every key in order."""
    names = labels.select(S.label_key(F.col("label")).alias("key")).where("key <> ''").distinct()
    pairs = names.select("key", F.explode(F.array(F.lit("B"), F.lit("I"))).alias("p")).select(S.bio(F.col("p"), F.col("key")).alias("bio"), "key", "p")
    first = labels.sparkSession.createDataFrame([("O", "", "")], "bio string, key string, p string")
    return first.unionByName(pairs).select((F.row_number().over(Window.orderBy("key", "p")) - 1).cast("int").alias("label_id"), "bio")


def split_pivot(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs (doc_id, dataset_name, split), counts (doc_id, n): documents and mean n of each data set, by split."""
    rows = docs.join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("dataset_name").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 6).alias("mean"))
    return out.na.fill(0, [c for c in out.columns if c.endswith("_docs")])
