"""The engine's long tables made from delivered OCR tokens: tokens, blocks and record keys.

Tokens have the columns doc_id, tok_idx (place in canonical order), text, char_start, char_end, page, x0, y0, x1, y1,
page_width, page_height, block_id; blocks have doc_id, block_id, page, char_start, char_end, text, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.session import guard

TOKEN_FIELDS = ["text", "char_start", "char_end", "page", "x0", "y0", "x1", "y1", "page_width", "page_height", "block_id"]


def by_document(df: DataFrame) -> DataFrame:
    """Rows partitioned by document, once: whatever groups, orders or joins by document and more then stays in place.

    That takes ``spark.sql.requireAllClusterKeysForCoPartition`` off, which is read when a query is planned and so holds for
    the session: joins on several keys use a partitioning by some of them wherever there is one.
    """
    guard(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition("doc_id")


def clean_tokens(delivered: DataFrame, doc_col: str = "rec_id") -> DataFrame:
    """Each token once, as loaded last; sides in order; null text empty. Null document or place is left out."""
    rows = delivered.where(F.col(doc_col).isNotNull() & F.col("tok_idx").isNotNull()).withColumnRenamed(doc_col, "doc_id")
    last = by_document(rows).groupBy("doc_id", "tok_idx").agg(F.max_by(F.struct(*TOKEN_FIELDS), F.struct("loaded_at", *TOKEN_FIELDS)).alias("t"))
    side = {f"{a}{k}": f(f"t.{a}0", f"t.{a}1").alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.least), (1, F.greatest))}
    fields = [side.get(f, F.coalesce("t.text", F.lit("")).alias("text") if f == "text" else F.col(f"t.{f}")) for f in TOKEN_FIELDS]
    return last.select("doc_id", "tok_idx", *fields)


READING = ["page", "char_start", "y0", "x0", "char_end", "tok_idx"]
LAYOUT = ["page", "y0", "x0", "char_start", "tok_idx"]


def ordered(tokens: DataFrame, order: list[str], name: str) -> DataFrame:
    """Tokens with their place in an order of the document, from 0; ties go by place of delivery."""
    return tokens.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def joined_text(tokens: DataFrame, keys: list[str], order: list[str], by: str = " ") -> DataFrame:
    """keys, text: token texts of each group in order, joined and without blanks at the ends."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return tokens.groupBy(*keys).agg(F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), by)).alias("text"))


def context(tokens: DataFrame, window: int = 5) -> DataFrame:
    """Each token with the texts around it, up to ``window`` on either side."""
    around = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(-window, window)
    return tokens.withColumn("context", F.array_join(F.collect_list("text").over(around), " "))


def page_sizes(pages: DataFrame) -> DataFrame:
    """(raw_id, page_no, page_width, page_height): of pages with both sizes; the largest where a page is listed again."""
    known = pages.where("page_width is not null and page_height is not null")
    return known.groupBy("raw_id", "page_no").agg(F.max(F.struct("page_width", "page_height")).alias("s")).select("raw_id", "page_no", "s.*")


def with_running_offsets(boxes: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("y0", "x0", "box_no")) -> DataFrame:
    """Box texts as one text with a line each: char_start and char_end by prefix sums of their lengths."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return boxes.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def doc_key(*candidates: Column) -> Column:
    """The first key that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates))


def to_pixels(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes whose four sides all lie in 0 .. 1 as pixels of their page, of 1000 without known size, rounded half to even;
    other boxes are rounded only. entries and sizes share raw_id and page_no; sizes go along."""
    rows = entries.join(sizes, ["raw_id", "page_no"], "left")
    sides = ["x0", "y0", "x1", "y1"]
    unit = F.forall(F.array(*sides), lambda v: (v >= 0) & (v <= 1))
    size = {"x": F.coalesce("page_width", F.lit(1000.0)), "y": F.coalesce("page_height", F.lit(1000.0))}
    pixels = {s: F.rint(F.col(s) * F.when(F.col("__unit"), size[s[0]]).otherwise(1.0)).cast("int") for s in sides}
    return rows.withColumn("__unit", unit).withColumns(pixels).drop("__unit")
