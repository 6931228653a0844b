"""Result tables and written records."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, of equal keys the new one (null equals null); with none of the keys present, each different row once."""
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)), allowMissingColumns=True)
    have = [k for k in keys if k in both.columns]
    columns = [c for c in both.columns if c != "__at"]
    if not have:
        return both.drop("__at").distinct()
    rank = F.row_number().over(Window.partitionBy(*have).orderBy(F.desc("__at"), *(F.desc_nulls_last(c) for c in columns if c not in have)))
    return both.withColumn("__rank", rank).where("__rank = 1").select(*columns)


def with_errors(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with errors): ``checks`` gives an SQL condition for each error; the second has an ``error`` column."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in checks.items())))
    rows = df.withColumn("error", F.array_join(found, ","))
    return rows.where("error = ''").drop("error"), rows.where("error <> ''")


def write_records(records: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "serializer"), mode: str = "overwrite", compression: str = "none") -> None:
    """Records as JSON lines in a folder for each data set and strategy; nulls are kept as such."""
    rows = records.repartition(*by) if by else records
    rows.write.mode(mode).partitionBy(*by).option("ignoreNullFields", "false").option("compression", compression).json(path)


def timed(frames: dict[str, DataFrame]) -> DataFrame:
    """(strategy, seconds): how long each takes to be made in full."""
    seconds = []
    for name, frame in frames.items():
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        seconds.append((name, time.perf_counter() - began))
    return next(iter(frames.values())).sparkSession.createDataFrame(seconds, "strategy string, seconds double")


def best_first(summary: DataFrame, value: str = "test_non_o_micro_f1_mean") -> DataFrame:
    return summary.orderBy(F.desc_nulls_last(value))
