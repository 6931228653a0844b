"""Sequential work on groups of rows as a stream over sorted partitions, without a call of pandas per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folia.session import map_arrow


def map_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """``work(key, columns)`` gets one group's other columns as lists, in order, and returns rows; the result has the keys and the rows' columns."""
    names = [c for c in df.columns if c not in keys]
    n_keys = len(keys)
    arrow = _out_schema(df, keys, schema)[1]

    def done(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        columns = [c.to_pylist() for c in table.columns]
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns[:n_keys])
            group = {n: c[a:b] for n, c in zip(names, columns[n_keys:], strict=True)}
            rows.extend((*key, *r) for r in work(key, group))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return _over_groups(df, keys, order, names, done, schema)


def map_tables(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, pa.Table], list], schema: str) -> DataFrame:
    """As map_groups, with a group's other columns as an Arrow table; ``work`` returns the columns of the result."""
    names = [c for c in df.columns if c not in keys]
    n_keys = len(keys)
    arrow = _out_schema(df, keys, schema)[1]

    def done(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            group = table.slice(a, b - a)
            columns = work(tuple(group.column(k)[0].as_py() for k in range(n_keys)), group.select(names))
            if len(columns[0]):
                key = [pa.repeat(group.column(k)[0], len(columns[0])) for k in range(n_keys)]
                made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*key, *made], arrow, strict=True)], schema=arrow)

    return _over_groups(df, keys, order, names, done, schema)


def _out_schema(df: DataFrame, keys: list[str], schema: str) -> tuple[T.StructType, pa.Schema]:
    out = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(schema).fields])
    return out, to_arrow_schema(out)


def _over_groups(df: DataFrame, keys: list[str], order: list[str], names: list[str], done: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``done(rows, cuts)`` over stretches of whole groups. Partitions are sorted by key, so a task holds one group and one batch at a time."""
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            cuts = _cuts(table, n_keys)[:-1]
            if len(cuts) > 1:
                yield from done(table.slice(0, cuts[-1]), cuts)
            carry = table.slice(cuts[-1])
        if carry is not None:
            yield from done(carry, [0, carry.num_rows])

    sorted_rows = df.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys, *order)
    return map_arrow(sorted_rows, run, _out_schema(df, keys, schema)[0])


def _cuts(table: pa.Table, n_keys: int) -> list[int]:
    """Places where a group begins, and the number of rows."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in range(n_keys):
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices if isinstance(codes, pa.DictionaryArray) else pa.concat_arrays([c.indices for c in codes.chunks])
        codes = codes.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(change).tolist(), table.num_rows]
