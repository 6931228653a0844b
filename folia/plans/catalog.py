"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.operators import align, documents, lineitems, metrics, quality, records, results, serialize, shred, splits, windows
from folia.plans import adapters, delivered, oracle
from folia.session import table
from folia.sources import annotations as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    toks = adapters.tokens(spark, d)
    return toks, adapters.annotations(toks)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return align.bio_labels(*_gold(spark, d))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tokens, and tokens with labels: strategies need the first only."""
    toks, anns = _gold(spark, d)
    return toks, align.bio_labels(toks, anns)


# tokens


@query
def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    return adapters.tokens(spark, d)


@query
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return documents.ordered(adapters.tokens(spark, d), documents.READING, "place").select("doc_id", "tok_idx", "place")


@query
def layout_order(spark: SparkSession, d: str) -> DataFrame:
    return documents.ordered(adapters.tokens(spark, d), documents.LAYOUT, "place").select("doc_id", "tok_idx", "place")


@query
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return documents.joined_text(adapters.tokens(spark, d), ["doc_id", "page"], ["tok_idx"])


@query
def token_context(spark: SparkSession, d: str) -> DataFrame:
    return documents.context(adapters.tokens(spark, d)).select("doc_id", "tok_idx", "context")


@query
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = adapters.tokens(spark, d).select("doc_id", F.col("tok_idx").alias("box_no"), "y0", "x0", "text")
    return documents.with_running_offsets(rows).select("doc_id", "box_no", "char_start", "char_end")


# geometry


@query
def normal_boxes(spark: SparkSession, d: str) -> DataFrame:
    return adapters.tokens(spark, d).select("doc_id", "tok_idx", *(v.alias(f"n_{k}") for k, v in S.normal_box().items()))


@query
def box_buckets(spark: SparkSession, d: str) -> DataFrame:
    return adapters.tokens(spark, d).select("doc_id", "tok_idx", *(v.alias(f"b_{k}") for k, v in S.box_features().items()))


@query
def raw_buckets(spark: SparkSession, d: str) -> DataFrame:
    return adapters.tokens(spark, d).select("doc_id", "tok_idx", *(v.alias(k) for k, v in S.raw_buckets().items()))


@query
def neighbour_iou(spark: SparkSession, d: str) -> DataFrame:
    toks = adapters.tokens(spark, d).select("doc_id", "tok_idx", "x0", "y0", "x1", "y1")
    pairs = toks.alias("a").join(toks.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.tok_idx") == F.col("a.tok_idx") + 1))
    return pairs.select("a.doc_id", "a.tok_idx", F.round(S.iou("a", "b"), 6).alias("iou"))


@query
def page_extents(spark: SparkSession, d: str) -> DataFrame:
    sides = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    return adapters.tokens(spark, d).groupBy("doc_id", "page").agg(*(f(s).alias(s) for s, f in sides.items()), F.round(F.avg((F.col("y0") + F.col("y1")) / 2.0), 6).alias("middle"))


# labels and values


@query
def label_forms(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label")
    rows = _gold(spark, d)[1].select("label").distinct()
    return rows.select("label", S.label_key(label).alias("key"), S.label_name(label).alias("name"), S.is_money(label).alias("is_money"), S.is_date(label).alias("is_date"), S.is_line_item(label).alias("is_line_item"), S.without_line_item(label).alias("field"), S.normal_bio(S.bio("B", label)).alias("bio"))


@query
def value_forms(spark: SparkSession, d: str) -> DataFrame:
    rows, label, text = _gold(spark, d)[1], F.col("label"), F.col("text")
    return rows.select("doc_id", "ann_idx", S.money(text).alias("money"), S.money(text, True).alias("money_commas"), S.date_text(text).alias("date"), S.compact(text).alias("compact"), S.matching_form(label, text).alias("matching"), S.extracted_form(label, text).alias("extracted"))


@query
def money_of_orders(spark: SparkSession, d: str) -> DataFrame:
    price = F.format_number("o_totalprice", 2)
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("($"), price, F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" $"), price, F.lit("P-"), (F.col("o_orderkey") % 7).cast("string"))).otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", shown.alias("shown"))
    return rows.select("o_orderkey", S.money(F.col("shown")).alias("money"), S.decimal_text(F.col("shown")).alias("decimal_text"), S.without_ocr_suffix(F.col("shown")).alias("bare"))


# alignment


@query
def span_token_join(spark: SparkSession, d: str) -> DataFrame:
    return align.hits(*_gold(spark, d)).select("doc_id", "ann_idx", "tok_idx")


@query
def bio_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("doc_id", "tok_idx", "label")


@query
def bio_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return align.bio_labels(*_gold(spark, d), policy=align.LAST).select("doc_id", "tok_idx", "label")


@query
def align_issues(spark: SparkSession, d: str) -> DataFrame:
    return align.issues(*_gold(spark, d))


@query
def annotation_checks(spark: SparkSession, d: str) -> DataFrame:
    columns = ["doc_id", "ann_idx", "n_tokens", "token_indices", "token_text", "strict_match", "loose_match", "annotation_norm", "token_norm", "status", "page", "x0", "y0", "x1", "y1"]
    return align.checks(*_gold(spark, d)).select(*columns)


@query
def bio_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of labels with tokens to ignore among them, and a score."""
    rows = _labelled(spark, d)
    label = F.when((F.col("doc_id") + F.col("tok_idx")) % 23 == 0, "-100").otherwise(F.col("label"))
    return align.spans(rows.withColumns({"label": label, "score": F.col("tok_idx") % 10 / 10.0}), source="model").drop("span_no")


@query
def field_values(spark: SparkSession, d: str) -> DataFrame:
    return align.field_values(align.spans(_labelled(spark, d)))


@query
def gold_fields(spark: SparkSession, d: str) -> DataFrame:
    return align.gold_fields(_gold(spark, d)[1])


@query
def line_item_rows(spark: SparkSession, d: str) -> DataFrame:
    return lineitems.rows_of_items(align.spans(_labelled(spark, d)))


# quality and label statistics


@query
def quality_documents(spark: SparkSession, d: str) -> DataFrame:
    toks, anns = _gold(spark, d)
    return quality.by_document(adapters.docs(spark, d), align.checks(toks, anns))


@query
def quality_labels(spark: SparkSession, d: str) -> DataFrame:
    return quality.by_label(align.checks(*_gold(spark, d)))


@query
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return quality.kept_for_training(align.checks(*_gold(spark, d)), drop_mismatch=True).select("doc_id", "ann_idx", "label")


@query
def gold_spans(spark: SparkSession, d: str) -> DataFrame:
    return quality.gold_spans(align.checks(*_gold(spark, d))).select("doc_id", "ann_idx", "normalized_gold", "normalized_token", "status")


@query
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.label_counts(_gold(spark, d)[1])


@query
def labels_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return quality.labels_of_documents(_gold(spark, d)[1])


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = adapters.docs(spark, d)
    return docs, _gold(spark, d)[1].join(docs.where("has_annotations").select("doc_id"), "doc_id", "left_semi")


@query
def common_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that every document with at least eight annotations has."""
    docs, anns = _annotated(spark, d)
    many = anns.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 8").select("doc_id")
    return quality.common_labels(docs.join(many, "doc_id", "left_semi"), anns.join(many, "doc_id", "left_semi"))


@query
def labels_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    return quality.labels_by_frequency(*_annotated(spark, d), least=0.5)


@query
def bio_label_map(spark: SparkSession, d: str) -> DataFrame:
    return quality.bio_label_map(_gold(spark, d)[1].select("label"))


@query
def split_pivot(spark: SparkSession, d: str) -> DataFrame:
    return quality.split_pivot(adapters.docs(spark, d), adapters.tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")))


# strategies


def _items(name: str, **options: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        toks = adapters.tokens(spark, d)
        return serialize.strategy(name, **options)(toks, adapters.blocks(toks) if name == "block_aware" else None)

    QUERIES[f"ser_{name}" + "".join(f"_{v}" for v in options.values() if isinstance(v, str))] = run


for _name in serialize.STRATEGIES:
    _items(_name)
_items("compact_bbox_token", position="suffix")
_items("lmdx_coord_suffix", mode="bbox")


@query
def t5_prompt(spark: SparkSession, d: str) -> DataFrame:
    toks, anns = _gold(spark, d)
    return serialize.prompt(toks, adapters.docs(spark, d), anns)


@query
def t5_target(spark: SparkSession, d: str) -> DataFrame:
    return serialize.target(_gold(spark, d)[1])


@query
def t5_line_items(spark: SparkSession, d: str) -> DataFrame:
    return serialize.target(_gold(spark, d)[1], line_items=True)


# records


def _layout_items(toks: DataFrame) -> DataFrame:
    """Tokens in layout order: an order that differs from the canonical one."""
    rows = documents.ordered(toks, documents.LAYOUT, "pos")
    return rows.select("doc_id", "pos", "text", F.col("tok_idx").alias("src"), F.lit(serialize.OCR).alias("role"))


@query
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    toks, labelled = _both(spark, d)
    return records.relabel(_layout_items(toks), labelled).select("doc_id", "pos", "src", "label")


@query
def collapsed(spark: SparkSession, d: str) -> DataFrame:
    toks, labelled = _both(spark, d)
    return records.collapse(records.relabel(serialize.page_aware(toks), labelled))


@query
def length_multiplier(spark: SparkSession, d: str) -> DataFrame:
    toks = adapters.tokens(spark, d)
    return records.stats(serialize.rowcol_bucket(toks))


@query
def item_problems(spark: SparkSession, d: str) -> DataFrame:
    """Items with planted faults: tokens left out, tokens twice, a marker with a label, tokens without one."""
    toks, labelled = _both(spark, d)
    items = records.relabel(serialize.page_aware(toks), labelled)
    k = F.col("doc_id") + F.col("src")
    rows = items.where(F.col("src").isNull() | (k % 11 != 0))
    rows = rows.withColumn("copy", F.explode(F.when(k % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    label = F.when(F.col("src").isNull() & (F.col("doc_id") % 5 == 0), "B-agency").when(k % 17 == 0, None).otherwise(F.col("label"))
    return records.problems(rows.withColumn("label", label), toks)


@query
def assembled(spark: SparkSession, d: str) -> DataFrame:
    toks, labelled = _both(spark, d)
    made = records.assemble(records.relabel(serialize.page_aware(toks), labelled), toks, adapters.docs(spark, d), "page_aware")
    text = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))))
    return made.select("id", "dataset", "serializer", "original_token_count", "serialized_token_count", text(F.col("tokens")).alias("tokens"), text(F.col("labels")).alias("labels"), text(F.col("source_token_indices")).alias("sources"), text(F.col("pages")).alias("pages"))


# windows


def _several(toks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    out = None
    for name in names:
        items = serialize.strategy(name)(toks).withColumn("strategy", F.lit(name))
        out = items if out is None else out.unionByName(items)
    return out


@query
def common_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of a strategy that takes tokens with a page size and one that takes tokens of blocks, the documents that both have."""
    toks = adapters.tokens(spark, d)
    sized = serialize.page_aware(toks.where("page_width is not null")).withColumn("strategy", F.lit("page_aware"))
    both = sized.unionByName(serialize.plain_text(toks.where("block_id is not null")).withColumn("strategy", F.lit("plain_text")))
    return windows.common_documents(both).groupBy("strategy", "doc_id").agg(F.count("*").alias("n"))


@query
def training_text(spark: SparkSession, d: str) -> DataFrame:
    return windows.training_text(serialize.page_aware(adapters.tokens(spark, d))).select("doc_id", "pos", "text")


@query
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    toks, labelled = _both(spark, d)
    return windows.word_windows(records.relabel(serialize.page_aware(toks), labelled), 64, 16)


#: Strategies whose windows are to be the same: a choice of the experiment, of which any number may be given.
FAIR = ("plain_text", "page_aware", "rowcol_bucket", "line_aware")


def _fair(toks: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = windows.training_text(_several(toks, FAIR))
    items = items.withColumn("pieces", windows.piece_count(F.col("text")))
    return items, windows.fair_windows(items, labelled, 512, piece_stride=32)


@query
def fair_windows(spark: SparkSession, d: str) -> DataFrame:
    return _fair(*_both(spark, d))[1].select("doc_id", "strategy", "chunk_index", "word_start", "word_end", "n_pieces")


@query
def tokenized_runs(spark: SparkSession, d: str) -> DataFrame:
    made = _fair(*_both(spark, d))[1]
    return windows.tokenization_summary(made, adapters.docs(spark, d), "four letters", windows.effective_length(512, None), piece_stride=32)


@query
def window_examples(spark: SparkSession, d: str) -> DataFrame:
    toks, labelled = _both(spark, d)
    items, made = _fair(toks, labelled)
    parts = [records.relabel(items.where(F.col("strategy") == s).drop("strategy", "pieces"), labelled).withColumn("strategy", F.lit(s)) for s in FAIR]
    rows = windows.examples(made, reduce(DataFrame.unionByName, parts), toks)
    return rows.groupBy("doc_id", "strategy", "chunk_index").agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"), F.sum("box_mask").alias("n_boxes"), F.sum("page").alias("pages"))


# splits


@query
def split_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_ratio(adapters.docs(spark, d))


@query
def stable_seeds(spark: SparkSession, d: str) -> DataFrame:
    return adapters.docs(spark, d).select("dataset_name").distinct().select("dataset_name", splits.stable_seed(42, F.col("dataset_name")).alias("seed"))


@query
def sampled_documents(spark: SparkSession, d: str) -> DataFrame:
    return windows.sample_documents(adapters.docs(spark, d).select("doc_id"), 40)


def _strata(spark: SparkSession, d: str) -> DataFrame:
    toks, labelled = _both(spark, d)
    items = records.relabel(serialize.plain_text(toks), labelled).withColumn("strategy", F.lit("plain_text"))
    return splits.strata(adapters.docs(spark, d), items)


@query
def document_strata(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)


@query
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.folds(_strata(spark, d))


@query
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_summary(splits.folds(_strata(spark, d)), serialize.page_aware(adapters.tokens(spark, d)).withColumn("strategy", F.lit("page_aware")))


# metrics and results


@query
def token_vote(spark: SparkSession, d: str) -> DataFrame:
    return metrics.vote(adapters.predictions(_labelled(spark, d)))


@query
def token_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_metrics(token_vote(spark, d))


@query
def label_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_report(token_vote(spark, d))


@query
def entity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.entity_metrics(token_vote(spark, d))


@query
def bio_repair(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repair(token_vote(spark, d), "pred").select("doc_id", "src", "pred")


@query
def missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without prediction, where windows leave out some."""
    labelled = _labelled(spark, d)
    expected = labelled.groupBy("doc_id").agg(F.count("*").alias("n_tokens")).withColumn("record", F.lit(0))
    return metrics.missing(metrics.vote(adapters.predictions(labelled).where((F.col("doc_id") * 3 + F.col("src")) % 10 != 0)), expected)


@query
def fold_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenization_summary").withColumn("value", F.col("n_tokenized_chunks") / F.col("n_docs"))
    return metrics.over_folds(rows, ["strategy", "model_name"], ["value", "mean_subtokens"])


@query
def upserted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenization_summary").select(F.lower(F.trim("dataset_name")).alias("dataset_name"), "strategy", "model_name", "n_docs", "created_at")
    old, new = rows.where("n_docs % 2 = 0"), rows.where("n_docs % 2 = 1")
    return results.upsert(old, new, ["dataset_name", "strategy", "model_name"])


@query
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    checks = {"no_text": "text is null", "no_dataset": "dataset_name is null", "late": "ingested_at > scanned_at + interval 30 days"}
    return results.with_errors(table(spark, d, "canon_docs"), checks)[1].select("rec_id", "error")


# sources


@query
def export_labels(spark: SparkSession, d: str) -> DataFrame:
    return sources.label_spans(table(spark, d, "raw_exports"), "raw_id")


@query
def export_label_report(spark: SparkSession, d: str) -> DataFrame:
    return sources.label_report(sources.label_spans(table(spark, d, "raw_exports"), "raw_id"))


@query
def export_alignment(spark: SparkSession, d: str) -> DataFrame:
    exports = table(spark, d, "raw_exports")
    toks = shred.token_table(exports).select(F.col("raw_id").alias("doc_id"), F.col("tok_no").cast("int").alias("tok_idx"), F.coalesce("text", F.lit("")).alias("text"), "char_start", "char_end", F.col("page_no").alias("page"), "x0", "y0", "x1", "y1")
    checked = align.checks(toks, sources.label_spans(exports, "raw_id"))
    return quality.by_label(checked)


@query
def found_entities(spark: SparkSession, d: str) -> DataFrame:
    value = F.create_map(F.lit("words"), F.regexp_extract("text", r"^\S+\s+(\S+\s+\S+)", 1), F.lit("spaced"), F.regexp_replace(F.regexp_extract("text", r"^\S+\s+(\S+\s+\S+)", 1), r"\s+", "   "), F.lit("none"), F.lit("no such value here"), F.lit("empty"), F.lit(""))
    rows = table(spark, d, "canon_docs").where("text is not null").select("rec_id", "text", value.alias("entities"))
    return sources.entity_spans(rows, "rec_id", "text", "entities")


# nested payloads


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.token_links(table(spark, d, "raw_exports"))


@query
def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return shred.token_table(table(spark, d, "raw_exports"))


@query
def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    return shred.block_table(table(spark, d, "raw_exports"))


@query
def p3_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What each payload is and holds."""
    return shred.payload_table(table(spark, d, "raw_exports"))


@query
def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    return shred.page_table(table(spark, d, "raw_exports"))


def queries() -> dict[str, Query]:
    return QUERIES | delivered.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.statements().items() if k in queries()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled tokens under two strategies: their length multipliers and labelled items by data set."""
    toks, labelled = _both(spark, sf_dir)
    items = records.relabel(serialize.page_aware(toks), labelled)
    rows = items.join(adapters.docs(spark, sf_dir), "doc_id")
    return rows.groupBy("dataset_name").agg(F.count("*").alias("n_items"), F.count("src").alias("n_tokens"), F.count_if(F.col("label").isNotNull() & (F.col("label") != "O")).alias("n_labelled"))
