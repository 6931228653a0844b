"""Encoding with a public byte-level tokenizer, and the token budget of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import bpe, presplit
from folia.llm.columns import chunks, code_points, string_array
from folia.session import map_arrow

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_ENCODERS: dict[tuple[int, str], object] = {}


def ship_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file as a broadcast: it is read on the driver only, and its size is that of the public file."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _in_process(data: bytes, make: type) -> object:
    """One ``make`` for a process and vocabulary, with what it has learned."""
    key = (hash(data), make.__name__)
    if key not in _ENCODERS:
        presplit.char_classes()
        _ENCODERS[key] = make(bpe.parse_vocabulary(data))
    return _ENCODERS[key]


def _pieces(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(pieces of all texts, offsets of each text's pieces)."""
    points, offs, whole = code_points(column)
    starts = presplit.piece_starts(points, offs)
    places = starts.tolist()
    pieces = [whole[a:b] for a, b in zip(places, [*places[1:], len(points)], strict=True)] if places else []
    return pieces, np.searchsorted(starts, offs)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, ids array<int>): each text as the ids of a byte-level BPE, without special tokens.

    Speculate and verify: greedy longest-match proposes the tokens of all new pieces of a chunk in
    step, every adjacent pair of tokens is checked for whether exact merging would leave it so, and only
    pieces with a failing pair are merged exactly. No shuffle; each process remembers a bounded number of pieces.

    Null and empty texts give an empty list; a null id is kept; repeated rows give repeated rows;
    an empty table an empty result; other columns are ignored, whatever their names. Text that looks
    like a special token is plain text.
    """
    shipped = ship_vocabulary(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: bpe.Encoder = _in_process(shipped.value, bpe.Encoder)
        for batch in batches:
            texts = string_array(batch.column(1))
            for lo, hi in chunks(texts):
                pieces, row = _pieces(texts.slice(lo, hi - lo))
                index = encoder.indices(pieces)
                ends = np.zeros(len(index) + 1, np.int64)
                np.cumsum(encoder.counts(index), out=ends[1:])
                ids = pa.ListArray.from_arrays(pa.array(ends[row].astype(np.int32)), pa.array(encoder.gather(index)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


class PieceCounter:
    """Subtokens of pieces: the distinct new ones are merged exactly, in step, then only counted."""

    def __init__(self, vocab: bpe.Vocabulary, keep: int = 400_000) -> None:
        self.vocab, self.keep = vocab, keep
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        if None in found:
            new = list({p for p, k in zip(pieces, found, strict=True) if k is None})
            if len(self.known) + len(new) > self.keep and self.known:
                self.known = {}
                return self.counts(pieces)
            flat, offs = bpe.flatten([p.encode("utf-8") for p in new])
            self.known.update(zip(new, bpe.merge_in_step(self.vocab, flat, np.diff(offs))[1].tolist(), strict=True))
            found = list(map(self.known.__getitem__, pieces))
        return np.array(found, np.int64)


def count_subtokens(rows: DataFrame, text_col: str, keep: list[str], name: str, as_words: bool = False, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and the number of subtokens of ``text_col`` as ``name``.

    The distinct pre-split pieces of a chunk become symbol arrays whose adjacent pairs are joined with the
    merge ranks again and again, the lowest rank first, until none is left. ``as_words``: each text is one
    word among others, so a blank comes before it, as where a sequence of words is tokenized. Null and
    empty texts have 0.
    """
    shipped = ship_vocabulary(rows.sparkSession, tokenizer)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: PieceCounter = _in_process(shipped.value, PieceCounter)
        for batch in batches:
            texts = string_array(batch.column(n_keep))
            if as_words:
                texts = string_array(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " ")))
            # equal texts of a batch are cut and counted once
            coded = texts.dictionary_encode()
            once, parts = coded.dictionary, []
            for lo, hi in chunks(once):
                pieces, row = _pieces(once.slice(lo, hi - lo))
                ends = np.zeros(len(pieces) + 1, np.int64)
                np.cumsum(counter.counts(pieces), out=ends[1:])
                parts.append(np.diff(ends[row]))
            counts = np.concatenate(parts)[coded.indices.to_numpy()] if parts else np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(counts)], [*(f"k{k}" for k in range(n_keep)), "n"])

    schema = ", ".join([*(f"k{k} {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "n bigint"])
    return map_arrow(rows.select(*keep, text_col), run, schema).toDF(*keep, name)


def plain_name(column: Column) -> Column:
    """A data set's name in one spelling: lower case, without surrounding blanks, ``_`` for hyphen and blank."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]", "_")


def plain_split(column: Column) -> Column:
    """train, val or test from any spelling; null stays null."""
    name = F.lower(F.trim(column))
    return F.when(name == "training", "train").when(name.isin("validation", "dev"), "val").otherwise(name)


def subtokens(canon: DataFrame, tokens: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per canon_docs row: rec_id, dataset_name, source, lang (all in one spelling), n_subtokens of the
    text, and of its OCR tokens their number, n_ocr_tokens, and their subtokens, n_ocr_subtokens.

    A token delivered twice counts once; null texts have no subtokens; a record without tokens has 0 of
    them; tokens of unknown records are left out; null lang is ``und``. Repeated canon_docs rows give repeated rows.
    """
    texts = count_subtokens(canon.select("rec_id", plain_name(F.col("dataset_name")).alias("dataset_name"), "source", F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), "text"), "text", ["rec_id", "dataset_name", "source", "lang"], "n_subtokens", tokenizer=tokenizer)
    each = count_subtokens(tokens.select("rec_id", "tok_idx", "text"), "text", ["rec_id", "tok_idx"], "n", as_words=True, tokenizer=tokenizer)
    once = each.groupBy("rec_id", "tok_idx").agg(F.max("n").alias("n"))
    per_record = once.groupBy("rec_id").agg(F.count("*").alias("n_ocr_tokens"), F.sum("n").alias("n_ocr_subtokens"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_ocr_tokens", "n_ocr_subtokens")]
    return texts.join(per_record, "rec_id", "left").select("rec_id", "dataset_name", "source", "lang", "n_subtokens", *zero)


def budget(per_record: DataFrame) -> DataFrame:
    """Totals of subtokens: by source, lang and dataset_name together, by each alone, and over all.

    ``by`` says which; the columns that a row isn't grouped by are null.
    """
    dims = ["source", "lang", "dataset_name"]
    sums = [F.count("*").alias("n_records"), *(F.sum(c).alias(c) for c in ("n_subtokens", "n_ocr_tokens", "n_ocr_subtokens"))]
    cube = per_record.groupingSets([[F.col(d) for d in dims], *([F.col(d)] for d in dims), []], *dims).agg(F.grouping_id().alias("g"), *sums)
    by = F.when(F.col("g") == 0, "source,lang,dataset_name").when(F.col("g") == 3, "source").when(F.col("g") == 5, "lang").when(F.col("g") == 6, "dataset_name").otherwise("all")
    return cube.select(by.alias("by"), *dims, "n_records", "n_subtokens", "n_ocr_tokens", "n_ocr_subtokens")


def latest_summary(summary: DataFrame) -> DataFrame:
    """Each run of tokenization_summary as reported last; the run is told by data set, strategy, model and lengths."""
    run = [plain_name(F.col("dataset_name")).alias("dataset_name"), "strategy", "model_name", "effective_max_length", "tokenizer_stride"]
    rest = ["n_base_word_chunks", "n_tokenized_chunks", "n_docs", "mean_subtokens", "max_subtokens", "total_padded_subtokens"]
    last = F.max_by(F.struct(*rest), F.struct("created_at", *rest)).alias("last")
    return summary.groupBy(*run).agg(last).select("dataset_name", "strategy", "model_name", "effective_max_length", "tokenizer_stride", "last.*")


def beside_summary(per_record: DataFrame, summary: DataFrame) -> DataFrame:
    """Every run's last report beside the corpus' own totals of its data set; null where the corpus has none of it."""
    own = per_record.groupBy("dataset_name").agg(F.count("*").alias("corpus_records"), F.sum("n_subtokens").alias("corpus_subtokens"), F.sum("n_ocr_subtokens").alias("corpus_ocr_subtokens"), F.round(F.avg("n_subtokens"), 6).alias("corpus_mean_subtokens"))
    return latest_summary(summary).join(own, "dataset_name", "left")
