"""Character spans of annotations on tokens: interval join, BIO labels, spans and field dictionaries.

Annotations have doc_id, ann_idx, label, char_start, char_end, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S

#: Characters in a stretch of text: tokens and spans meet by document and stretch, so a long document is many keys.
STRETCH = 2048
FIRST, LAST, FAIL = "keep_first", "overwrite", "error"


def _stretches(start: Column, end: Column, stretch: int) -> Column:
    lo = F.floor(start / stretch)
    return F.sequence(lo, F.greatest(lo, F.floor(F.greatest(start, end - 1) / stretch)))


def hits(tokens: DataFrame, annotations: DataFrame, least: float = 0.5, stretch: int = STRETCH, touching: bool = False) -> DataFrame:
    """Tokens that lie in an annotation's span with at least a part ``least`` of their length: the annotation's columns
    as a_*, with doc_id, ann_idx and the token's tok_idx and text, page and box.

    An interval join: both sides are keyed by document and the stretches of text they reach into, and a pair counts
    in the first stretch that both have. ``touching``: tokens that only touch the span count as well.
    """
    more = 1 if touching else 0
    left = annotations.select("doc_id", "ann_idx", F.col("label").alias("a_label"), F.col("char_start").alias("a_start"), F.col("char_end").alias("a_end"), F.col("text").alias("a_text"), F.explode(_stretches(F.col("char_start") - more, F.col("char_end") + more, stretch)).alias("stretch"))
    right = tokens.select("doc_id", "tok_idx", "text", "char_start", "char_end", "page", "x0", "y0", "x1", "y1", F.explode(_stretches(F.col("char_start"), F.col("char_end"), stretch)).alias("stretch"))
    both = left.join(right, ["doc_id", "stretch"])
    first = F.greatest(F.floor((F.col("a_start") - more) / stretch), F.floor(F.col("char_start") / stretch))
    shared = S.overlap(F.col("char_start"), F.col("char_end"), F.col("a_start"), F.col("a_end"))
    enough = (shared > 0) & (shared / F.greatest(F.lit(1), F.col("char_end") - F.col("char_start")) >= least)
    if touching:
        enough = enough | ((shared == 0) & ((F.col("char_end") == F.col("a_start")) | (F.col("char_start") == F.col("a_end"))))
    return both.where((F.col("stretch") == first) & enough).drop("stretch")


def labelled_hits(found: DataFrame) -> DataFrame:
    """hits with the BIO label that each would give its token: B for an annotation's first token, I for the rest."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "ann_idx").orderBy("tok_idx"))
    return found.withColumn("bio", S.bio(F.when(rank == 1, "B").otherwise("I"), S.label_key(F.col("a_label"))))


_ORDER = ["a_start", "a_end", "a_label", "ann_idx"]


def bio_labels(tokens: DataFrame, annotations: DataFrame, policy: str = FIRST, least: float = 0.5) -> DataFrame:
    """Tokens with ``label``: that of the first annotation on them by start, end and label (keep_first) or of the
    last (overwrite); O without any. Whether an annotation's label begins with B is decided before
    conflicts, so I can stand alone. ``error``: a token with two annotations fails the query."""
    if policy not in (FIRST, LAST, FAIL):
        raise ValueError(f"policy must be {FIRST}, {LAST} or {FAIL}")
    pick = F.min_by if policy == FIRST else F.max_by
    label = pick("bio", F.struct(*_ORDER))
    if policy == FAIL:
        label = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("token has more than one label: "), F.first("tok_idx").cast("string")))).otherwise(label)
    chosen = labelled_hits(hits(tokens, annotations, least)).groupBy("doc_id", "tok_idx").agg(label.alias("label"))
    return tokens.join(chosen, ["doc_id", "tok_idx"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def issues(tokens: DataFrame, annotations: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, issue_type, ann_idx, tok_idx): annotations without tokens, and annotations after the first on a token."""
    found = hits(tokens, annotations, least)
    unmatched = annotations.join(found.select("doc_id", "ann_idx").distinct(), ["doc_id", "ann_idx"], "left_anti")
    later = found.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "tok_idx").orderBy(*_ORDER))).where("rank > 1")
    none = unmatched.select("doc_id", F.lit("no_token_match").alias("issue_type"), "ann_idx", F.lit(None).cast("int").alias("tok_idx"))
    return none.unionByName(later.select("doc_id", F.lit("label_conflict").alias("issue_type"), "ann_idx", F.col("tok_idx").cast("int").alias("tok_idx")))


def checks(tokens: DataFrame, annotations: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per annotation: its tokens' number, places, text, box and page (null unless one), whether their text is
    the annotation's, strictly or loosely, both in the form that is compared, and status: unavailable, ok or loose_mismatch."""
    sides = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    parts = F.array_sort(F.collect_list(F.struct("tok_idx", "text")))
    found = hits(tokens, annotations, least).groupBy("doc_id", "ann_idx").agg(
        F.count("*").alias("n_tokens"),
        parts.alias("parts"),
        *(f(s).alias(s) for s, f in sides.items()),
        F.when(F.min("page") == F.max("page"), F.min("page")).alias("page"),
    )
    rows = annotations.join(found, ["doc_id", "ann_idx"], "left")
    token_text = F.trim(F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<tok_idx:int,text:string>>")), lambda p: p["text"]), " "))
    rows = rows.withColumn("token_text", token_text).withColumn("token_indices", F.array_join(F.transform("parts", lambda p: p["tok_idx"]), ","))
    label, gold, token = F.col("label"), F.col("text"), F.col("token_text")
    rows = rows.withColumns({"__money": S.is_money(label), "__date": S.is_date(label)})
    kind = F.col("__money"), F.col("__date")
    rows = rows.withColumns({"n_tokens": F.coalesce("n_tokens", F.lit(0)), "token_indices": F.coalesce("token_indices", F.lit("")), "strict_match": S.squash(token) == S.squash(gold), "annotation_norm": S.form_by_kind(*kind, gold), "token_norm": S.form_by_kind(*kind, token)})
    rows = rows.withColumn("loose_match", S.forms_match(F.col("annotation_norm"), F.col("token_norm")))
    status = F.when(F.col("n_tokens") == 0, "unavailable").when(F.col("loose_match"), "ok").otherwise("loose_mismatch")
    return rows.withColumn("status", status).drop("parts", "__money", "__date")


def spans(labelled: DataFrame, normalize: bool = False, source: str = "gold") -> DataFrame:
    """BIO labels as spans, one row each: label, first and last token, text, range, box, the page if it is one, and source; with
    ``score`` in labelled, the mean of its tokens'.

    Islands: a token begins a span if it is B, has another entity than the token before, or follows one without. O, -100
    and null end a span. A label without hyphen begins one always. Labels with other prefixes belong to none.
    """
    by = Window.partitionBy("doc_id").orderBy("tok_idx")
    label = F.col("label")
    bare = (F.instr(label, "-") == 0) & (label != "O")
    entity = F.when(label.rlike("^[BI]-"), S.bio_entity_raw(label)).when(bare, label)
    rows = labelled.withColumn("entity", entity)
    before = F.lag("entity").over(by)
    begins = F.col("entity").isNotNull() & (bare | F.startswith(label, F.lit("B-")) | before.isNull() | (before != F.col("entity")))
    rows = rows.withColumn("span_no", F.sum(begins.cast("int")).over(by)).where("entity is not null")
    score = [F.round(F.avg("score"), 6).alias("score")] if "score" in labelled.columns else []
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "text"))), lambda p: p["text"]), " "))
    out = rows.groupBy("doc_id", "span_no").agg(
        F.first("entity").alias("label"),
        text.alias("text"),
        F.min("tok_idx").alias("token_start"),
        F.max("tok_idx").alias("token_end"),
        F.min_by("char_start", "tok_idx").alias("char_start"),
        F.max_by("char_end", "tok_idx").alias("char_end"),
        F.when(F.min("page") == F.max("page"), F.min("page")).alias("page"),
        *(f(s).alias(s) for s, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))),
        *score,
        F.lit(source).alias("source"),
    )
    return out.withColumn("text", S.extracted_form(F.col("label"), F.col("text"))) if normalize else out


def field_values(found: DataFrame, normalize: bool = True, repeated: tuple[str, ...] = ()) -> DataFrame:
    """spans -> (doc_id, label, n_values, is_list, value): values in order, a list where there are several or the label may repeat."""
    value = S.extracted_form(F.col("label"), F.col("text")) if normalize else F.col("text")
    values = F.transform(F.array_sort(F.collect_list(F.struct("token_start", value.alias("v")))), lambda p: p["v"])
    rows = found.groupBy("doc_id", "label").agg(F.count("*").alias("n_values"), F.array_join(values, "|").alias("value"))
    return rows.withColumn("is_list", (F.col("n_values") > 1) | F.col("label").isin(*repeated) if repeated else F.col("n_values") > 1)


def gold_fields(annotations: DataFrame, repeated: tuple[str, ...] = ()) -> DataFrame:
    """annotations -> (doc_id, label, n_values, is_list, value) with labels as keys and values in their extracted form."""
    keyed = annotations.select("doc_id", S.label_key(F.col("label")).alias("label"), S.extracted_form(F.col("label"), F.col("text")).alias("text"), F.struct("char_start", "char_end", "ann_idx").alias("token_start"))
    return field_values(keyed, normalize=False, repeated=repeated)
