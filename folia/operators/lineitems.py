"""Spans of line items as rows of a table, by height on the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.operators.groups import map_groups


def rows_of_items(spans: DataFrame, reach: float = 12.0) -> DataFrame:
    """spans with label line_item_* -> (doc_id, page, row_no, cell_no, label, text): from the top, a span joins the first
    row whose mean middle is within ``reach``; cells go from left to right. Rows are numbered on each page."""
    some = spans.where(F.startswith("label", F.lit("line_item_")) & F.col("page").isNotNull())
    some = some.withColumn("middle", (F.col("y0") + F.col("y1")) / 2.0).select("doc_id", "page", "middle", "x0", "token_start", "label", "text")

    def work(key: tuple, g: dict[str, list]) -> list[tuple]:
        rows: list[list[int]] = []
        for k, m in enumerate(g["middle"]):
            row = next((r for r in rows if abs(sum(g["middle"][j] for j in r) / len(r) - m) <= reach), None)
            if row is None:
                rows.append([k])
            else:
                row.append(k)
        return [(n, c, g["label"][k], g["text"][k]) for n, r in enumerate(rows) for c, k in enumerate(sorted(r, key=lambda k: (g["x0"][k], k)))]

    return map_groups(some, ["doc_id", "page"], ["middle", "x0", "token_start"], work, "row_no int, cell_no int, label string, text string")
