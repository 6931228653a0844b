"""The queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from folia.llm import bpe_sql, encode, form_sql, leakage, lookalike, pieces
from folia.llm.encode import plain_name, plain_split
from folia.llm.neardup import NearDuplicates
from folia.llm.overlap import SplitOverlap
from folia.session import cut_lineage, table


def _p1(spark: SparkSession, d: str) -> NearDuplicates:
    canon = table(spark, d, "canon_docs")
    docs = canon.select(F.col("rec_id").alias("id"), plain_name(F.col("dataset_name")).alias("part"), "text")
    return NearDuplicates(docs, threshold=0.6, width=3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = _p1(spark, d).groups()
    return groups.select(F.col("id").alias("rec_id"), F.col("part").alias("dataset_name"), "class_id", "group_id", "n_links")


def _p2(canon: DataFrame) -> SplitOverlap:
    split = plain_split(F.col("split"))
    docs = canon.select(F.col("rec_id").alias("id"), F.when(split == "train", False).when(split.isin("val", "test"), True).alias("is_eval"), "text")
    return SplitOverlap(docs, threshold=0.75, width=3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(table(spark, d, "canon_docs")).pairs()


def p2_affected(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records, and how many of them stand in a training record, for each split and source."""
    canon = table(spark, d, "canon_docs")
    split = plain_split(F.col("split"))
    hit = _p2(canon).affected().distinct().withColumn("hit", F.lit(1))
    rows = canon.select("rec_id", split.alias("split"), "source").where(F.col("split").isin("val", "test"))
    rows = rows.join(hit.withColumnRenamed("id", "rec_id"), "rec_id", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_affected"))


def _p5_records(spark: SparkSession, d: str) -> DataFrame:
    return encode.subtokens(table(spark, d, "canon_docs"), table(spark, d, "ocr_tokens"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "ocr_tokens"), table(spark, d, "canon_docs"), table(spark, d, "run_configs"))


def p5_subtokens(spark: SparkSession, d: str) -> DataFrame:
    return _p5_records(spark, d)


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    return encode.budget(_p5_records(spark, d))


def p5_beside_summary(spark: SparkSession, d: str) -> DataFrame:
    return encode.beside_summary(_p5_records(spark, d), table(spark, d, "tokenization_summary"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def _p7(spark: SparkSession, d: str) -> leakage.Leaks:
    return leakage.Leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).found().select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).by_item()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.Lookalikes(table(spark, d, "documents")).pairs()


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.Lookalikes(table(spark, d, "documents")).groups()


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_affected, p4_found, p5_subtokens, p5_budget, p5_beside_summary, p6_ids, p7_found, p7_items, p8_found, p8_groups, p8_text)}


_NAME = "regexp_replace(lower(trim(dataset_name)), '[\\s-]', '_', 'g')"
_SPLIT = "case lower(trim(split)) when 'training' then 'train' when 'validation' then 'val' when 'dev' then 'val' else lower(trim(split)) end"
#: gram: the distinct three-word runs of each canon_docs row; size: their number.
_GRAMS = f"""word as (select rec_id, {_NAME} as part, {_SPLIT} as split, source, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as w from canon_docs where text is not null),
    gram as (select distinct rec_id, part, split, source, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from word where len(w) >= 3),
    size as (select rec_id, count(*) as n from gram group by 1)"""
_NEAR = f"""{_GRAMS}, both_ as (select a.rec_id as a, b.rec_id as b, count(*) as c from gram a join gram b on a.part = b.part and a.s = b.s and a.rec_id < b.rec_id group by 1, 2),
    pair as (select a as rec_a, b as rec_b from both_ join size x on a = x.rec_id join size y on b = y.rec_id where c >= 0.6 * (x.n + y.n - c))"""
_OVER = f"""{_GRAMS}, hit as (select a.rec_id as e, b.rec_id as t, count(*) as c from gram a join gram b on a.split in ('val', 'test') and b.split = 'train' and a.s = b.s group by 1, 2),
    pair as (select e, t from hit join size on e = rec_id where c >= 0.75 * n)"""


def oracle_sql() -> dict[str, str]:
    """Those of all problems but 3, which is general. p6_ids has lists, which not every comparison of tables takes: its statement is
    ``bpe_sql.ids``, and a test holds them together."""
    limit = "case when word_window_size > 0 then word_window_size else max_length end"
    return form_sql.statements() | bpe_sql.statements() | {
        "p1_found": f"with {_NEAR} select rec_a, rec_b from pair",
        "p1_groups": f"""with recursive {_NEAR}, edge as (select rec_a as x, rec_b as y from pair union all select rec_b, rec_a from pair),
            reach as (select distinct rec_id as x, rec_id as y from gram union select r.x, e.y from reach r join edge e on r.y = e.x),
            cls as (select rec_id, part, min(rec_id) over (partition by part, s) as class_id from (select rec_id, part, list_sort(list(s)) as s from gram group by 1, 2))
            select rec_id, part as dataset_name, class_id, (select min(y) from reach where x = rec_id) as group_id, (select count(*) from edge where x = rec_id) as n_links from cls""",
        "p2_found": f"with {_OVER} select distinct least(e, t) as rec_a, greatest(e, t) as rec_b from pair",
        "p2_affected": f"""with {_OVER} select split, source, count(*) as n_records, count(h.e) as n_affected from (select rec_id, {_SPLIT} as split, source from canon_docs) r
            left join (select distinct e from pair) h on r.rec_id = h.e where split in ('val', 'test') group by 1, 2""",
        "p4_found": f"""with recursive tok as (select rec_id, tok_idx, min(page) as page, min(block_id) as block_id from ocr_tokens group by 1, 2),
            place as (select *, row_number() over w - 1 as k, lag(page) over w as p, lag(block_id) over w as b from tok window w as (partition by rec_id order by tok_idx)),
            rec as (select rec_id, count(*) as n, list(tok_idx order by k) as idx, coalesce(list(k order by k) filter (k > 0 and (page is distinct from p or block_id is distinct from b)), []) as cuts from place group by 1),
            job as (select config_id, r.rec_id, n, cuts, idx, {limit} as l, coalesce(word_window_stride, 0) as s from rec r join (select rec_id, {_NAME} as part from canon_docs) d on r.rec_id = d.rec_id
                join (select *, {_NAME} as part from run_configs) c on d.part = c.part where n > {limit}),
            cut as (select config_id, rec_id, n, cuts, idx, l, s, 0 as no, 0::bigint as a, case when l >= n then n else coalesce(list_max(list_filter(cuts, lambda x: x > l / 2 and x <= l)), l) end as e from job
                union all select config_id, rec_id, n, cuts, idx, l, s, no + 1, e - s, case when e - s + l >= n then n else coalesce(list_max(list_filter(cuts, lambda x: x > e - s + l / 2 and x <= e - s + l)), e - s + l) end from cut where e < n)
            select config_id, rec_id, no::int as piece_no, idx[a + 1] as tok_from, idx[e] as tok_to from cut""",
    }
