"""Records of serialized documents: BIO labels in the emitted order, assembly, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S

IGNORED = -100


def entity_instances(labelled: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, tok_idx, entity, instance): which entity of its document each token belongs to; I without a
    like token before it begins one. ``strict``: prefixes other than B and I count as O, else as B."""
    by = Window.partitionBy("doc_id").orderBy("tok_idx")
    rows = labelled.select("doc_id", "tok_idx", S.bio_prefix(F.col("label"), strict).alias("prefix"), S.bio_entity(F.col("label"), strict).alias("entity"))
    begins = F.col("entity").isNotNull() & ((F.col("prefix") != "I") | ~F.lag("entity").over(by).eqNullSafe(F.col("entity")))
    return rows.select("doc_id", "tok_idx", "entity", F.when(F.col("entity").isNotNull(), F.sum(begins.cast("int")).over(by)).alias("instance"))


def relabel(items: DataFrame, labelled: DataFrame, strict: bool = False) -> DataFrame:
    """Items with ``label`` in the emitted order: I where the token before, over layout items, is of the same entity
    instance, else B. Layout items have none (null; -100 in written records)."""
    rows = items.join(entity_instances(labelled, strict).withColumnRenamed("tok_idx", "src"), ["doc_id", "src"], "left")
    # 0 stands for tokens without entity, so that the last one before is that of a token, never of a layout item
    instance = F.when(F.col("src").isNotNull(), F.coalesce("instance", F.lit(0)))
    before = F.last(instance, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    label = F.when(F.col("entity").isNull(), "O").otherwise(S.bio(F.when(before == F.col("instance"), "I").otherwise("B"), F.col("entity")))
    return rows.withColumn("label", F.when(F.col("src").isNotNull(), label)).select(*items.columns, "label")


def collapse(items: DataFrame, policy: str = "first_non_o") -> DataFrame:
    """Items with predicted labels -> (doc_id, tok_idx, label): one for each token, the first that isn't O or the last; ``error``: fails on two that differ."""
    real = items.where("src is not null")
    not_o = F.col("label") != "O"
    if policy == "last":
        label = F.max_by("label", "pos")
    elif policy in ("first_non_o", "error"):
        label = F.coalesce(F.min_by(F.when(not_o, F.col("label")), F.when(not_o, F.col("pos"))), F.lit("O"))
        if policy == "error":
            label = F.when(F.count_distinct(F.when(not_o, F.col("label"))) > 1, F.raise_error(F.lit("labels of one token differ"))).otherwise(label)
    else:
        raise ValueError("policy must be first_non_o, last or error")
    return real.groupBy("doc_id", F.col("src").alias("tok_idx")).agg(label.alias("label"))


def stats(items: DataFrame) -> DataFrame:
    """(doc_id, n_items, n_real, n_layout, length_multiplier)."""
    n_real = F.count("src")
    return items.groupBy("doc_id").agg(F.count("*").alias("n_items"), n_real.alias("n_real"), (F.count("*") - n_real).alias("n_layout"), F.round(F.count("*") / F.greatest(F.lit(1), n_real), 6).alias("length_multiplier"))


def problems(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, problem, n): tokens that an order lacks or has twice, layout items with a label, tokens without one.
    Empty where all is right; labels are checked where items have them."""
    emitted = items.where("src is not null").groupBy("doc_id", F.col("src").alias("tok_idx")).agg(F.count("*").alias("n"))
    both = tokens.select("doc_id", "tok_idx").join(emitted, ["doc_id", "tok_idx"], "full")
    n = F.coalesce("n", F.lit(0))
    parts = [both.where(n == 0).select("doc_id", F.lit("missing").alias("problem")), both.where(n > 1).select("doc_id", F.lit("repeated").alias("problem"))]
    if "label" in items.columns:
        parts += [items.where("src is null and label is not null").select("doc_id", F.lit("labelled layout").alias("problem")), items.where("src is not null and label is null").select("doc_id", F.lit("no label").alias("problem"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


def label_ids(items: DataFrame, label_map: DataFrame) -> DataFrame:
    """Items with ``label_id`` by label_map (label_id, bio): -100 for layout items and those without a label. A label that the map
    lacks fails the query."""
    known = label_map.select(F.col("bio").alias("label"), F.col("label_id").alias("__id"))
    rows = items.join(known, "label", "left")
    lack = F.raise_error(F.concat(F.lit("no id for label "), F.col("label"))).cast("int")
    plain = F.col("label").isNull() | (F.col("label") == str(IGNORED)) | F.col("src").isNull()
    return rows.withColumn("label_id", F.when(plain, IGNORED).when(F.col("__id").isNull(), lack).otherwise(F.col("__id")).cast("int")).select(*items.columns, "label_id")


def record_key(rows: DataFrame) -> Column:
    """The key of a written record's document: the first of its keys, its ids and those of its metadata that isn't empty, else file and line."""
    have = lambda c: [F.col(c)] if c in rows.columns else []
    meta = [F.col("metadata")[k] for k in ("doc_key", "id", "doc_id", "original_filename")] if "metadata" in rows.columns else []
    candidates = [*(c for name in ("doc_key", "id", "doc_id") for c in have(name)), *meta]
    if "source_path" in rows.columns:
        candidates.append(F.concat(F.col("source_path"), F.lit("::fallback::"), F.col("source_line_number").cast("string")))
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def with_slots(rows: DataFrame, order: tuple[str, ...] = ("source_path", "source_line_number")) -> DataFrame:
    """Written records with doc_key (see record_key) and ``occurrence``, from 0: which of the records of its data set and strategy under that key it is."""
    rows = rows.withColumn("doc_key", record_key(rows))
    by = Window.partitionBy("dataset", "serializer", "doc_key").orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(by) - 1)


def with_sources(made: DataFrame, facts: DataFrame, seed: int = 42) -> DataFrame:
    """Records with split, source_split, source_folder, source_row_index and doc_key of their documents, the splits in their metadata as
    well; facts (id, dataset, split and as many of the others as there are)."""
    names = [c for c in ("source_split", "source_folder", "source_row_index", "doc_key") if c in facts.columns]
    rows = made.drop(*names, "split").join(facts.select("id", "dataset", "split", *names), ["id", "dataset"], "left")
    added = {"new_seeded_split": F.col("split"), "split_seed": F.lit(str(seed))} | ({"source_split": F.col("source_split")} if "source_split" in names else {})
    added = F.map_filter(F.create_map(*(x for k, v in added.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    own = F.map_filter("metadata", lambda k, v: ~k.isin("new_seeded_split", "split_seed", "source_split")) if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    return rows.withColumn("metadata", F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), added))


def assemble(items: DataFrame, tokens: DataFrame, docs: DataFrame, strategy: str, labelled: DataFrame | None = None) -> DataFrame:
    """One record per document with parallel arrays, as it is written: id, dataset, serializer, tokens, labels (if items have
    any), loss_mask, source_token_indices, layout_roles, item_attrs, pages, bboxes, normalized_bboxes, offsets and counts;
    doc_key and metadata if docs have them, and original_token_labels of ``labelled`` (doc_id, tok_idx, label)."""
    box = S.normal_box()
    norm = F.when(box["x0"].isNotNull() & box["y0"].isNotNull(), F.array(*box.values()))
    facts = tokens.select("doc_id", F.col("tok_idx").alias("src"), "page", F.array("x0", "y0", "x1", "y1").alias("bbox"), norm.alias("norm"), F.array("char_start", "char_end").alias("offset"))
    rows = items.join(facts, ["doc_id", "src"], "left")
    by = Window.partitionBy("doc_id").orderBy("pos")
    last = F.last("page", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.first("page", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("page", F.when(F.col("role") == "coord_suffix", last).otherwise(F.coalesce(coming, last)))
    attrs = F.col("attrs") if "attrs" in items.columns else F.when(F.col("src").isNull(), F.create_map(F.lit("page"), F.col("page").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    labels = ["label"] if "label" in items.columns else []
    parts = F.array_sort(F.collect_list(F.struct("pos", "text", "src", "role", "page", "bbox", "norm", "offset", *labels)))
    at = F.map_from_entries(F.collect_list(F.struct("pos", attrs.alias("a"))))
    made = rows.groupBy("doc_id").agg(parts.alias("p"), at.alias("attrs"))
    counts = tokens.groupBy("doc_id").agg(F.count("*").alias("original_token_count"))
    take = lambda f: F.transform("p", lambda x: x[f])
    columns: dict[str, Column] = {"tokens": take("text")}
    if labels:
        columns["labels"] = F.transform("p", lambda x: F.coalesce(x["label"], F.lit(str(IGNORED))))
    columns |= {
        "loss_mask": F.transform("p", lambda x: x["src"].isNotNull()),
        "source_token_indices": take("src"),
        "layout_roles": take("role"),
        "item_attrs": F.transform("p", lambda x: F.element_at("attrs", x["pos"])),
        "pages": take("page"),
        "bboxes": take("bbox"),
        "normalized_bboxes": take("norm"),
        "offsets": take("offset"),
        "serialized_token_count": F.size("p"),
    }
    more = [c for c in ("doc_key", "metadata") if c in docs.columns]
    out = docs.select("doc_id", "dataset_name", *more).join(made, "doc_id").join(counts, "doc_id")
    if labelled is not None:
        own = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "label"))), lambda x: x["label"])
        out = out.join(labelled.groupBy("doc_id").agg(own.alias("own_labels")), "doc_id", "left")
        columns["original_token_labels"] = F.col("own_labels")
    return out.select(F.col("doc_id").alias("id"), F.col("dataset_name").alias("dataset"), F.lit(strategy).alias("serializer"), *more, "original_token_count", *(c.alias(k) for k, c in columns.items()))
