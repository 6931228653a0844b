"""Records written as files arrive: the strategies over a stream of whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folia.operators import documents, records, serialize
from folia.operators.results import write_records


def serialize_stream(stream: DataFrame, docs: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, strategies: list[str]) -> StreamingQuery:
    """Serialize delivered tokens batch by batch, one folder for each data set and strategy; every batch must hold whole documents.

    ``docs`` gives (doc_id, dataset_name) of a batch. A batch that is run again replaces its own files, so each is written once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        tokens = documents.clean_tokens(rows)
        for name in strategies:
            made = records.assemble(serialize.strategy(name)(tokens), tokens, docs(rows), name)
            write_records(made, f"{out}/batch={number}/strategy={name}", by=("dataset",))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
