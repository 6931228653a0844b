"""Deterministic splits of documents: by ratio, and stratified folds. Orders are those of a seeded hash, so
that any engine gives the same split and no shuffle of keys on one machine is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.session import cut_lineage


def hash_order(seed: int | Column, key: str = "doc_id") -> Column:
    prefix = F.lit(f"{seed}:") if isinstance(seed, int) else F.concat(seed.cast("string"), F.lit(":"))
    return F.md5(F.concat(prefix, F.col(key).cast("string")))


def stable_seed(seed: int, name: Column) -> Column:
    """The first eight hexadecimal digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("bigint")


#: Ranges of hashes that a ranking is cut into; each is sorted by itself.
RANGES = 4096


def hash_range(digest: Column) -> Column:
    """The range of a hexadecimal digest: ranges follow each other as the digests do."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def ranked(rows: DataFrame, keys: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """Rows with their rank among those of the same keys, from 1, by ``order``; ``part`` numbers ranges that follow each other in that
    order. Rows are sorted within ranges only, and ranks go on from the sizes of the ranges before, so a key
    that has a third of all rows is as many tasks as it has ranges. rows are read twice."""
    rows = rows.withColumns({"__key": F.struct(*keys) if keys else F.struct(F.lit(0)), "__part": part})
    sizes = rows.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__key", "__part").orderBy(*order))
    both = rows.withColumn("__own", own).join(sizes.select("__key", "__part", before.alias("__before")), ["__key", "__part"])
    return both.withColumn(name, F.col("__before") + F.col("__own")).drop("__key", "__part", "__own", "__before")


def by_ratio(docs: DataFrame, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """docs (dataset_name, doc_id) -> with split: of each data set, train and val rounded down, the rest test."""
    rows = cut_lineage(docs.select("dataset_name", "doc_id").distinct())  # one short row for a document, read several times
    digest = hash_order(seed)
    sizes = rows.groupBy(F.struct("dataset_name").alias("key")).agg(F.count("*").alias("n"))
    placed = ranked(rows, ["dataset_name"], hash_range(digest), [digest, F.col("doc_id")], "rank").withColumn("key", F.struct("dataset_name")).join(sizes, "key")
    n_train, n_val = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return placed.select("dataset_name", "doc_id", split.alias("split"))


def strata(docs: DataFrame, labelled_items: DataFrame) -> DataFrame:
    """docs (doc_id) -> (doc_id, stratum): the entity that most items of a document have, over all strategies; of equal ones
    that which comes first by strategy and place; only_o without any. labelled_items (strategy, doc_id, pos, label)."""
    rows = labelled_items.withColumn("entity", S.bio_entity(F.col("label"), False)).where("entity is not null")
    counts = rows.groupBy("doc_id", "entity").agg(F.count("*").alias("n"), F.min(F.struct("strategy", "pos")).alias("first"))
    best = counts.groupBy("doc_id").agg(F.min_by("entity", F.struct((-F.col("n")).alias("n"), "first")).alias("entity"))
    return docs.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("has_entities:"), F.col("entity")), F.lit("only_o")).alias("stratum"))


def folds(stratified: DataFrame, k: int = 5, seed: int = 42, validation: float = 0.1) -> DataFrame:
    """(doc_id, stratum) -> a row for each fold and document: fold, doc_id, stratum, split, outer_splitter, inner_splitter.

    Documents of a stratum are dealt to folds in turn if there are several strata with k or more each, else all are
    dealt together. Of a fold's other documents, ``validation`` (rounded half to even, one at least) are its
    validation part, in even shares of the strata if each side can have all of them. Fewer than k documents fail.
    """
    stratified = cut_lineage(stratified)  # one short row for a document, read several times
    sizes = stratified.groupBy("stratum").agg(F.count("*").alias("size"))
    facts = sizes.agg(F.count("*").alias("n_strata"), F.min("size").alias("least"), F.sum("size").alias("n"))
    rows = stratified.crossJoin(facts)
    few = F.when(F.col("n") < k, F.raise_error(F.concat(F.lit(f"fewer than {k} documents: "), F.col("n").cast("string")))).otherwise((F.col("n_strata") > 1) & (F.col("least") >= k))
    rows = rows.withColumns({"outer": few, "group": F.when(few, F.col("stratum")).otherwise("")})
    digest = hash_order(seed)
    rows = ranked(rows, ["group"], hash_range(digest), [digest, F.col("doc_id")], "deal")
    rows = cut_lineage(rows.select("doc_id", "stratum", "outer", ((F.col("deal") - 1) % k).cast("int").alias("own_fold")))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test = rows.where("fold = own_fold").withColumn("split", F.lit("test"))
    rest = rows.where("fold <> own_fold")
    # of each fold: what may be known from the sizes of its strata
    sizes = rest.groupBy("fold", "stratum").agg(F.count("*").alias("size"))
    facts = sizes.groupBy("fold").agg(F.sum("size").alias("n"), F.count("*").alias("strata"), F.min("size").alias("least"))
    facts = facts.withColumn("n_val", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.rint(F.col("n") * F.lit(validation)).cast("int"))))
    can = (F.col("strata") > 1) & (F.col("least") >= 2) & (F.col("n_val") >= F.col("strata")) & (F.col("n") - F.col("n_val") >= F.col("strata"))
    facts = facts.select("fold", "n_val", can.alias("can"))
    digest = hash_order(F.lit(seed) + F.col("fold"))
    rest = ranked(rest, ["fold", "stratum"], hash_range(digest), [digest, F.col("doc_id")], "r").join(sizes, ["fold", "stratum"]).join(facts, "fold")
    share = F.when(F.col("can"), (F.col("r") - 0.5) / F.col("size")).otherwise(0.0)
    rest = cut_lineage(rest.select("fold", "doc_id", "stratum", "outer", "can", "n_val", share.alias("share")))
    part = F.when(F.col("can"), F.floor(F.col("share") * RANGES).cast("int")).otherwise(hash_range(digest))
    rest = ranked(rest, ["fold"], part, [F.col("share"), digest, F.col("doc_id")], "place")
    rest = rest.withColumn("split", F.when(F.col("place") <= F.col("n_val"), "validation").otherwise("train"))
    both = rest.select("fold", "doc_id", "stratum", "split", "outer").unionByName(test.select("fold", "doc_id", "stratum", "split", "outer")).join(facts.select("fold", "can"), "fold", "left")
    return both.select("fold", "doc_id", "stratum", "split", F.when(F.col("outer"), "stratified").otherwise("plain").alias("outer_splitter"), F.when(F.col("can"), "stratified").otherwise("plain").alias("inner_splitter"))


def split_summary(assigned: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and items of each strategy by fold and split; items (strategy, doc_id)."""
    n = items.groupBy("strategy", "doc_id").agg(F.count("*").alias("n"))
    return n.join(assigned.select("doc_id", "fold", "split"), "doc_id").groupBy("strategy", "fold", "split").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_items"))


def fold_rows(rows: DataFrame, assigned: DataFrame, fold: int, split: str) -> DataFrame:
    """The rows of one split of a fold."""
    return rows.join(assigned.where((F.col("fold") == fold) & (F.col("split") == split)).select("doc_id"), "doc_id", "left_semi")
