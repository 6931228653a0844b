"""Evaluation of predicted labels: by token and by entity, and over folds.

Predictions have doc_id, record, row_no and position (their order of evaluation), src, gold and pred (labels); rows
with src or gold below 0 or null are layout items. Several windows may predict one token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.session import cut_lineage

_TOKEN = ["doc_id", "record", "src"]


def vote(predictions: DataFrame) -> DataFrame:
    """(doc_id, record, src, gold, pred): the label most windows predict for a token, of equal ones the earliest.
    Gold labels of a token that differ fail the query."""
    real = predictions.where("src >= 0 and gold is not null")
    counts = real.groupBy(*_TOKEN, "pred").agg(F.count("*").alias("n"), F.min(F.struct("row_no", "position")).alias("first"), F.min("gold").alias("g0"), F.max("gold").alias("g1"))
    pred = F.min_by("pred", F.struct((-F.col("n")).alias("n"), "first"))
    gold = F.when(F.min("g0") != F.max("g1"), F.raise_error(F.lit("gold labels of one token differ"))).otherwise(F.min("g0"))
    return counts.groupBy(*_TOKEN).agg(gold.alias("gold"), pred.alias("pred"))


def missing(voted: DataFrame, expected: DataFrame) -> DataFrame:
    """(n_missing): tokens without prediction; expected (doc_id, record, n_tokens)."""
    have = voted.groupBy("doc_id", "record").agg(F.count("*").alias("n"))
    lack = F.greatest(F.lit(0), F.col("n_tokens") - F.coalesce("n", F.lit(0)))
    return expected.join(have, ["doc_id", "record"], "left").agg(F.coalesce(F.sum(lack), F.lit(0)).alias("n_missing"))


def repair(rows: DataFrame, label: str, keys: tuple[str, ...] = ("doc_id", "record"), order: str = "src") -> DataFrame:
    """Rows with ``label`` as valid BIO: I only where the row before is the token before it and has the same entity."""
    by = Window.partitionBy(*keys).orderBy(order)
    entity, prefix = S.bio_entity(F.col(label), True), S.bio_prefix(F.col(label), True)
    rows = rows.withColumns({"__e": entity, "__p": prefix})
    goes_on = (F.col("__p") == "I") & F.lag("__e").over(by).eqNullSafe(F.col("__e")) & (F.lag(order).over(by) == F.col(order) - 1)
    fixed = F.when(F.col("__e").isNull(), "O").otherwise(S.bio(F.when(goes_on, "I").otherwise("B"), F.col("__e")))
    return rows.withColumn(label, fixed).drop("__e", "__p")


def entity_spans(rows: DataFrame, label: str, keys: tuple[str, ...] = ("doc_id", "record"), order: str = "src") -> DataFrame:
    """(keys, entity, first, last) of repaired labels."""
    by = Window.partitionBy(*keys).orderBy(order)
    fixed = repair(rows.select(*keys, order, label), label, keys, order)
    fixed = fixed.withColumns({"entity": S.bio_entity(F.col(label), True), "no": F.sum(F.startswith(F.col(label), F.lit("B-")).cast("int")).over(by)}).where("entity is not null")
    return fixed.groupBy(*keys, "entity", "no").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("no")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores(correct: Column, predicted: Column, gold: Column) -> dict[str, Column]:
    """0 where there is nothing to divide by."""
    return {"precision": _ratio(correct, predicted), "recall": _ratio(correct, gold), "f1": _ratio(correct * 2.0, predicted + gold)}


def entity_metrics(voted: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1 over exact spans, mean F1 of the entities in gold or prediction, and counts."""
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("label"))
    both = voted.select("doc_id", "record", "src", F.explode(F.array(side("gold"), side("pred"))).alias("s")).select("doc_id", "record", "src", "s.*")
    found = entity_spans(both, "label", ("doc_id", "record", "side"))
    found = found.groupBy("doc_id", "record", "entity", "first", "last").agg(*(F.max(F.when(F.col("side") == n, 1)).alias(n[0]) for n in ("gold", "pred")))
    each = found.groupBy("entity").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("n_correct"))
    each = each.withColumn("f1", _scores(F.col("n_correct"), F.col("n_pred"), F.col("n_gold"))["f1"])
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("n_gold", "n_pred", "n_correct")}
    micro = _scores(sums["n_correct"], sums["n_pred"], sums["n_gold"])
    return each.agg(
        *(F.round(v, 6).alias(f"entity_micro_{k}") for k, v in micro.items()),
        F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("entity_macro_f1"),
        *(v.alias(f"{k}_entities") for k, v in sums.items()),
    )


def by_label(voted: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each label in gold or prediction; tokens count by their exact label."""
    side = lambda name, g, p, c: F.struct(F.col(name).alias("label"), F.lit(g).alias("g"), F.lit(p).alias("p"), c.alias("c"))
    same = (F.col("gold") == F.col("pred")).cast("int")
    sides = voted.select(F.explode(F.array(side("gold", 1, 0, same), side("pred", 0, 1, F.lit(0)))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("n_pred"), F.sum("c").alias("n_correct"))
    return sums.select("label", *(v.alias(k) for k, v in _scores(F.col("n_correct"), F.col("n_pred"), F.col("support")).items()), "support", "n_pred", "n_correct")


def token_metrics(voted: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall and F1 over the labels that occur, and micro ones without O."""
    rows = by_label(voted)
    kinds = ("precision", "recall", "f1")
    n = F.sum("support")
    weighted = {k: _ratio(F.sum(F.col(k) * F.col("support")), n) for k in kinds}
    real = F.col("label") != "O"
    micro = _scores(*(F.sum(F.when(real, F.col(c)).otherwise(0)) for c in ("n_correct", "n_pred", "support")))
    return rows.agg(
        F.round(_ratio(F.sum("n_correct"), n), 6).alias("accuracy"),
        *(F.round(F.coalesce(F.avg(k), F.lit(0.0)), 6).alias(f"macro_{k}") for k in kinds),
        *(F.round(v, 6).alias(f"weighted_{k}") for k, v in weighted.items()),
        *(F.round(v, 6).alias(f"non_o_micro_{k}") for k, v in micro.items()),
        F.coalesce(n, F.lit(0)).alias("n_eval_tokens"),
    )


def label_report(voted: DataFrame) -> DataFrame:
    """by_label with rows for the macro and the weighted average."""
    rows = cut_lineage(by_label(voted).select("label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support")))  # a row for a label
    n = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), *(F.avg(k).alias(k) for k in ("precision", "recall", "f1")), n.alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *(_ratio(F.sum(F.col(k) * F.col("support")), n).alias(k) for k in ("precision", "recall", "f1")), n.alias("support"))
    every = rows.unionByName(macro).unionByName(weighted)
    return every.select("label", *(F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")), "support")


def best_label(logits: Column, labels: Column) -> Column:
    """The label at the place of the largest logit, the first of equal ones."""
    return F.element_at(labels, F.array_position(logits, F.array_max(logits)).cast("int"))


def focal_loss(probability: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    """The focal loss of a token from the probability of its gold label."""
    return -F.lit(alpha) * F.pow(1 - probability, F.lit(gamma)) * F.log(probability)


def over_folds(results: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation of each value (null for one fold) and the number of folds; groups may be null."""
    stats = [f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_samp(c), 6)))]
    return results.groupBy(*groups).agg(*stats, F.count("*").alias("n_folds_completed"))
