"""Cutting long token sequences into overlapping pieces that end at page or block ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.encode import plain_name
from folia.session import map_arrow

#: Token numbers in a bucket: the unit in which tokens are put in order, so no task needs a whole record.
BUCKET = 8192


def _int(column: pa.Array, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def boundary_runs(tokens: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """tokens (rec_id, tok_idx, page, block_id) -> (rec_id, bucket, n, jump_at, jump_to, cut_at, first and last page and block).

    One row for each record and range of ``bucket`` token numbers, in which repeated tokens count once: the
    number n of tokens; where token numbers don't follow on each other (place, number), the first always;
    and the sorted boundary array of places whose page or block differs from that before. Rows are sorted
    within tasks and pass as a stream of batches, so memory doesn't grow with a record.
    """
    rows = tokens.where("rec_id is not null and tok_idx is not null").select(F.col("rec_id").cast("bigint").alias("rec_id"), F.floor(F.col("tok_idx") / bucket).cast("bigint").alias("bucket"), F.col("tok_idx").cast("bigint").alias("tok_idx"), F.col("page").cast("bigint").alias("page"), F.col("block_id").cast("bigint").alias("block_id"))
    order = ["rec_id", "bucket", "tok_idx", "page", "block_id"]
    names = ["rec_id", "bucket", "n", "jump_at", "jump_to", "cut_at", "page_first", "block_first", "page_last", "block_last"]
    null = -(1 << 62)  # stands for null, which equals null

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        for batch in batches:
            columns = [_int(c, null) for c in batch.columns]
            if carry is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(carry, columns, strict=True)]
            once = np.ones(len(columns[0]), bool)
            once[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[2][1:] != columns[2][:-1])
            columns = [c[once] for c in columns]
            # the last group may go on in the next batch
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) if len(columns[0]) else np.zeros(0, bool)
            end = int(np.argmax(same)) if len(same) else 0
            carry = [c[end:] for c in columns]
            if end:
                yield emit([c[:end] for c in columns])
        if carry is not None and len(carry[0]):
            yield emit(carry)

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        rec, buck, idx, page, block = columns
        head = np.ones(len(rec), bool)
        head[1:] = (rec[1:] != rec[:-1]) | (buck[1:] != buck[:-1])
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], len(rec))
        place = np.arange(len(rec)) - np.repeat(heads, ends - heads)
        jump = head.copy()
        jump[1:] |= idx[1:] != idx[:-1] + 1
        cut = np.zeros(len(rec), bool)
        cut[1:] = ((page[1:] != page[:-1]) | (block[1:] != block[:-1])) & ~head[1:]
        lists = []
        for on, values in ((jump, place), (jump, idx), (cut, place)):
            offs = np.zeros(len(rec) + 1, np.int32)
            np.cumsum(on, out=offs[1:])
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(offs[heads], offs[-1])), pa.array(values[on])))
        flat = [rec[heads], buck[heads], ends - heads]
        edge = [page[heads], block[heads], page[ends - 1], block[ends - 1]]
        return pa.RecordBatch.from_arrays([*map(pa.array, flat), *lists, *map(pa.array, edge)], names)

    schema = "rec_id bigint, bucket bigint, n bigint, jump_at array<bigint>, jump_to array<bigint>, cut_at array<bigint>, page_first bigint, block_first bigint, page_last bigint, block_last bigint"
    return map_arrow(rows.repartition("rec_id", "bucket").sortWithinPartitions(*order), work, schema)


def cut_points(n: int, cuts: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) place of each piece of n tokens with the sorted boundary array ``cuts``.

    The last boundary e with s + limit/2 < e <= s + limit is found by binary search; without one the cut is
    hard, at s + limit. The next piece starts ``overlap`` before the cut, one after this one's start at least.
    """
    out, s = [], 0
    while s + limit < n:
        k = int(np.searchsorted(cuts, s + limit, "right")) - 1
        e = int(cuts[k]) if k >= 0 and 2 * int(cuts[k]) > 2 * s + limit else s + limit
        out.append((s, e - 1))
        s = max(s + 1, e - overlap)
    out.append((s, n - 1))
    return out


def pieces(tokens: DataFrame, records: DataFrame, configs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(config_id, rec_id, piece_no, tok_from, tok_to) for each config and each record of its data set with more
    tokens than the limit.

    tokens (rec_id, tok_idx, page, block_id); records (rec_id, dataset_name); configs (config_id, dataset_name, max_length,
    word_window_size, word_window_stride). The limit is word_window_size, or max_length if that is null or 0;
    the overlap word_window_stride, null being 0; a config without a limit above 0 gives no pieces. Null
    rec_id and tok_idx are left out; tokens repeated with the same number count once (the first by page and
    block, if they differ); records and configs repeated with the same id count once; empty tables give
    an empty result. Data set names are compared in one spelling; other columns are ignored.
    """
    limit = F.coalesce(F.when(F.col("word_window_size") > 0, F.col("word_window_size")), F.col("max_length")).cast("bigint")
    overlap = F.greatest(F.coalesce("word_window_stride", F.lit(0)), F.lit(0)).cast("bigint")
    asked = configs.where("config_id is not null").dropDuplicates(["config_id"]).select(F.col("config_id").cast("bigint").alias("config_id"), plain_name(F.col("dataset_name")).alias("part"), limit.alias("lim"), overlap.alias("lap")).where("lim > 0")
    by_part = asked.groupBy("part").agg(F.collect_list(F.struct("config_id", "lim", "lap")).alias("configs"), F.min("lim").alias("least"))
    parts = records.where("rec_id is not null").select(F.col("rec_id").cast("bigint").alias("rec_id"), plain_name(F.col("dataset_name")).alias("part")).dropDuplicates(["rec_id"])
    runs = boundary_runs(tokens, bucket)
    whole = runs.groupBy("rec_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(*[c for c in runs.columns if c != "rec_id"]))).alias("runs"))
    jobs = whole.join(parts, "rec_id").join(by_part, "part").where("total > least").select("rec_id", "runs", "configs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for rec, runs, configs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, jump_at, jump_to, cuts, last = 0, [], [], [], None
                for run in runs:
                    jump_at.append(np.array(run["jump_at"]) + n)
                    jump_to.append(np.array(run["jump_to"]))
                    if last is not None and last != (run["page_first"], run["block_first"]):
                        cuts.append(np.array([n]))
                    cuts.append(np.array(run["cut_at"], np.int64) + n)
                    last, n = (run["page_last"], run["block_last"]), n + run["n"]
                at, to, cut = map(np.concatenate, (jump_at, jump_to, cuts))
                number = lambda p, at=at, to=to: int(to[k := int(np.searchsorted(at, p, "right")) - 1] + p - at[k])
                for c in configs:
                    if n > c["lim"]:
                        rows.extend((c["config_id"], rec, no, number(a), number(b)) for no, (a, b) in enumerate(cut_points(n, cut, c["lim"], c["lap"])))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], pa.int64() if k < 2 else pa.int32()) for k in range(5)], ["config_id", "rec_id", "piece_no", "tok_from", "tok_to"])

    return map_arrow(jobs, work, "config_id bigint, rec_id bigint, piece_no int, tok_from int, tok_to int")
