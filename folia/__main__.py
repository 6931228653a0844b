"""Command line: ``queries``, ``run NAME``, ``serialize`` and ``plan`` (strata, folds and windows of written records)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from folia.config import ExperimentConfig
from folia.operators import records, serialize, splits, windows
from folia.operators.results import write_records
from folia.plans import adapters, catalog
from folia.session import build_session
from folia.sources import readers


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folia", description=__doc__)
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(catalog.queries()))
    made = commands.add_parser("serialize")
    made.add_argument("--strategies", nargs="+", default=sorted(serialize.STRATEGIES))
    for command in (run, made):
        command.add_argument("--data", required=True)
        command.add_argument("--out", required=True)
    plan = commands.add_parser("plan")
    plan.add_argument("--records", required=True)
    plan.add_argument("--out", required=True)
    plan.add_argument("--set", nargs="*", default=[], dest="settings")
    args = parser.parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = build_session(args.master)
    if args.command == "run":
        catalog.queries()[args.name](spark, args.data).write.mode("overwrite").parquet(args.out)
    elif args.command == "serialize":
        tokens, docs = adapters.tokens(spark, args.data), adapters.docs(spark, args.data)
        for name in args.strategies:
            items = serialize.strategy(name)(tokens, adapters.blocks(tokens))
            write_records(records.assemble(items, tokens, docs, name).withColumnRenamed("serializer", "strategy"), f"{args.out}/serializer={name}", by=("dataset",))
    else:
        config = ExperimentConfig().with_settings(args.settings)
        rows = readers.records(spark, args.records, list(config.datasets) or None, list(config.strategies) or None)
        items = windows.common_documents(readers.items_of(rows))
        docs = items.select("doc_id").distinct()
        if config.sample_docs:
            docs = windows.sample_documents(docs, config.sample_docs, config.split_seed)
        stratum = splits.strata(docs, items.join(docs, "doc_id", "left_semi"))
        splits.folds(stratum, config.n_folds, config.split_seed, config.validation_fraction).write.mode("overwrite").parquet(f"{args.out}/folds")
        text = windows.training_text(items.join(docs, "doc_id", "left_semi"))
        text = windows.tokenizer_pieces(text, config.tokenizer) if config.tokenizer else text.withColumn("pieces", windows.piece_count(F.col("text")))
        first = readers.record_folders(spark, args.records, list(config.datasets) or None, list(config.strategies) or None)
        labelled = windows.canonical_labels(text.where(F.col("strategy") == min(s for _, s, _ in first)))
        fair = windows.fair_windows(text, labelled, config.max_length, 2, config.word_window_size, config.word_window_stride, config.tokenizer_stride)
        fair.write.mode("overwrite").partitionBy("strategy").parquet(f"{args.out}/windows")
        sets = rows.select(F.coalesce("doc_key", "id").alias("doc_id"), F.col("dataset").alias("dataset_name")).distinct()
        made = windows.tokenization_summary(spark.read.parquet(f"{args.out}/windows"), sets, config.tokenizer or "four letters", config.max_length, 2, config.tokenizer_stride)
        made.write.mode("overwrite").parquet(f"{args.out}/tokenization_summary")


if __name__ == "__main__":
    main()
