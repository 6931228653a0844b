"""Values inside JSON texts in their extracted form: the one place where forms are needed per value of a nest."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.session import map_arrow

_BLANKS = re.compile(S.BLANKS)


def extracted(key: str | None, value: object) -> str:
    """As scalars.extracted_form, by the same patterns, for one value under a key; without a key it is plain text."""
    if value is None:
        return ""
    text = re.sub(_BLANKS, " ", str(value)).strip(" ")
    name = re.sub("[^0-9a-z]+", "_", (key or "").lower().replace("&", " and ")).strip("_")
    if any(p in name for p in S.MONEY_PARTS):
        for left in S.LEFT_BEHIND:
            text = re.sub(left, "", text)
        text = text.strip(" ")
        if m := re.search(S.IN_PARENTHESES, text):
            return "-" + re.sub(r"[()$\s,]", "", m[0])
        if m := re.search(S.SIGNED, text):
            return re.sub(r"[+$\s,]", "", m[0])
        return re.sub(r"[$,]", "", text).strip(" ")
    if any(p in name for p in S.DATE_PARTS):
        return text.replace(" ", "")
    return text.translate(str.maketrans(S.SIGNS, S.PLAIN_SIGNS)).strip(" ")


def normal_values(value: object, key: str | None = None) -> object:
    """All values of a nest in their extracted form; a list's have the key of the list."""
    if isinstance(value, dict):
        return {k: normal_values(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [normal_values(v, key) for v in value]
    return extracted(key, value)


def normal_json(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """rows (key, JSON text) -> (key, value): the same JSON with normal values; null where it isn't JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(json.dumps(normal_values(json.loads(text)), ensure_ascii=False, sort_keys=True))
                except (TypeError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["k", "value"])

    kind = rows.schema[key].dataType.simpleString()
    return map_arrow(rows.select(key, F.col(json_col)), run, f"k {kind}, value string").withColumnRenamed("k", key)
