"""Training views and windows of serialized documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from folia.functions import scalars as S
from folia.operators.groups import map_tables
from folia.operators.metrics import repair
from folia.session import map_arrow

#: Roles whose marker holds for what follows it, in the order in which a window repeats them.
LASTING = ("page", "block", "column", "xycut_region", "line")


def common_documents(items: DataFrame) -> DataFrame:
    """items (strategy, doc_id, ...) of the documents that every strategy has."""
    have = items.select("strategy", "doc_id").distinct()
    n = have.select("strategy").distinct().agg(F.count("*").alias("n"))
    every = have.groupBy("doc_id").agg(F.count("*").alias("k")).crossJoin(n).where("k = n").select("doc_id")
    return items.join(every, "doc_id", "left_semi")


def sample_documents(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n documents in the order of a seeded hash: the same for the same seed, whatever the partitions."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id").limit(n)


def training_text(items: DataFrame) -> DataFrame:
    """Items as a model reads them: layout items as a token of the bounded vocabulary with their value, empty tokens as <EMPTY_OCR>."""
    mark, value = S.layout_token(F.col("role")), F.trim("text")
    layout = F.when((F.length(value) == 0) | (value == mark), mark).otherwise(F.concat_ws(" ", mark, value))
    real = F.when(F.length(F.trim("text")) > 0, F.col("text")).otherwise("<EMPTY_OCR>")
    return items.withColumn("text", F.when(F.col("src").isNull() | (F.col("role") != "ocr_token"), layout).otherwise(real))


def piece_count(text: Column) -> Column:
    """A stand-in for a tokenizer: a piece for every four characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int"))


def word_windows(items: DataFrame, size: int, stride: int) -> DataFrame:
    """(doc_id, chunk_index, word_start, word_end, n_labelled) of fixed windows that overlap by ``stride``; size 0 is the
    whole document. The last window is the first that reaches the end. items may have ``label``."""
    if size and not 0 <= stride < size:
        raise ValueError("stride must be at least 0 and below size")
    labelled = F.count("label") if "label" in items.columns else F.count("src")
    n = items.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    if not size:
        out = items.groupBy("doc_id").agg(F.count("*").cast("int").alias("word_end"), labelled.alias("n_labelled"))
        return out.select("doc_id", F.lit(0).alias("chunk_index"), F.lit(0).alias("word_start"), "word_end", "n_labelled")
    step = size - stride
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    windows = n.withColumn("last", last)
    pos = F.col("pos")
    first = F.greatest(F.lit(0), F.floor((pos - size) / step) + 1).cast("int")
    each = items.withColumn("chunk_index", F.explode(F.sequence(first, F.floor(pos / step).cast("int")))).join(windows, "doc_id").where("chunk_index <= last")
    start = F.col("chunk_index") * step
    return each.groupBy("doc_id", "chunk_index", "n").agg(labelled.alias("n_labelled")).select("doc_id", "chunk_index", start.alias("word_start"), F.least("n", start + size).alias("word_end"), "n_labelled")


#: Tokens whose pieces are summed up at a time when the end of a window is looked for.
STEP = 1024
ROLES = {r: k for k, r in enumerate(LASTING)}
SUFFIX, OTHER = len(LASTING), len(LASTING) + 1


class Emission:
    """A document under one strategy as arrays.

    A layout item that doesn't last belongs to one token, the next (a suffix to the one before, what comes last to the
    last). One that lasts, a marker, is in force for a stretch of emitted tokens. So a window takes the pieces of its
    tokens with their items, and once those of every marker that is in force for any of them.
    """

    def __init__(self, src: np.ndarray, role: np.ndarray, pieces: np.ndarray, n: int) -> None:
        places = np.flatnonzero(src >= 0)
        self.pieces = pieces
        order = src[places]
        if len(order) != n or (np.bincount(order, minlength=n) != 1).any():
            raise ValueError("incomplete OCR source coverage")
        self.emitted = np.empty(n, np.int64)  # token -> when it is emitted
        self.emitted[order] = np.arange(n)
        before = np.cumsum(src >= 0)
        lasts = (src < 0) & (role < SUFFIX)
        owner = np.where(src >= 0, before - 1, np.where((role == SUFFIX) & (before > 0), before - 1, np.minimum(before, n - 1)))
        items = np.flatnonzero(~lasts)
        self.items = items[np.argsort(owner[items], kind="stable")]
        self.first = np.searchsorted(owner[self.items], np.arange(n + 1))
        own = np.bincount(owner[items], pieces[items], n).astype(np.int64)
        # the marker of each role in force: the last one before, unless a page, or for lines any other region, began since
        at = np.arange(len(src))
        last = [np.maximum.accumulate(np.where(lasts & (role == k), at, -1))[places] for k in range(len(LASTING))]
        page, line = ROLES["page"], ROLES["line"]
        borders = [np.full(n, -1) if k == page else np.maximum.reduce(last[:line]) if k == line else last[page] for k in range(len(LASTING))]
        self.marker = np.stack([np.where(v > floor, v, -1) for v, floor in zip(last, borders, strict=True)])
        # in canonical order: pieces of each token, of its markers, and the token before that is under the same marker
        self.own = own[self.emitted]
        marker = self.marker[:, self.emitted]
        self.price = np.where(marker >= 0, pieces[marker], 0)
        self.since = np.full(marker.shape, -1)
        for values, since in zip(marker, self.since, strict=True):
            by = np.argsort(values, kind="stable")
            same = values[by[1:]] == values[by[:-1]]
            since[by[1:][same]] = by[:-1][same]

    def window(self, start: int, end: int) -> np.ndarray:
        """Places of a window's items in emitted order, markers before the first token under them."""
        when = np.sort(self.emitted[start:end])
        marker = self.marker[:, when]
        new = marker >= 0
        new[:, 1:] &= marker[:, 1:] != marker[:, :-1]
        role, k = np.nonzero(new)
        counts = self.first[when + 1] - self.first[when]
        ends = np.cumsum(counts)
        own = self.items[np.repeat(self.first[when] - (ends - counts), counts) + np.arange(ends[-1])]
        rank = np.append(k * (SUFFIX + 1) + role, np.repeat(np.arange(len(when)), counts) * (SUFFIX + 1) + SUFFIX)
        return np.append(marker[role, k], own)[np.argsort(rank, kind="stable")]


def entity_heads(labels: pa.Array) -> np.ndarray:
    """For each token that goes on an entity, the token with B that begins it; -1 for others and where there is no B."""
    prefix = pc.utf8_slice_codeunits(labels, 0, 2)
    inner, begins = (pc.equal(prefix, p).to_numpy(zero_copy_only=False) for p in ("I-", "B-"))
    entity = pc.utf8_slice_codeunits(labels, 2).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    goes_on = inner.copy()
    goes_on[:1] = False
    goes_on[1:] &= (entity[1:] == entity[:-1]) & (inner[:-1] | begins[:-1])
    head = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(inner))))
    return np.where(inner & begins[head], head, -1) if len(inner) else head


def plan_windows(views: list[Emission], heads: np.ndarray, usable: int, window: int = 0, stride: int = 0, piece_stride: int = 0) -> list[tuple[int, int]]:
    """(start, end) of windows of tokens that fit ``usable`` pieces under every strategy.

    Each is as long as fits, and as ``window`` if that is set; an entity that the end would cut goes to the next
    window if it begins inside this one. Windows overlap by ``stride`` tokens, or by the tokens that take
    ``piece_stride`` pieces. From a start, a token adds its own pieces and those of markers that no token since the start was
    under, so running sums of all strategies together give the end.
    """
    n = len(heads)
    own, price, since = (np.stack([getattr(v, name) for v in views]) for name in ("own", "price", "since"))
    alone = np.zeros(n + 1, np.int64)
    np.cumsum((own + price.sum(axis=1)).max(axis=0), out=alone[1:])
    start, out = 0, []
    while start < n:
        top = min(n, start + window) if window > 0 else n
        end, taken = start, np.zeros((len(views), 1), np.int64)
        while end < top:
            part = slice(end, min(top, end + STEP))
            sums = taken + np.cumsum(own[:, part] + (price[:, :, part] * (since[:, :, part] < start)).sum(axis=1), axis=1)
            fits = (sums <= usable).all(axis=0)
            if not fits.all():
                end += int(fits.argmin())
                break
            end, taken = part.stop, sums[:, -1:]
        if end == start:
            raise ValueError(f"token {start} with its layout takes more than {usable} pieces")
        if end < n and heads[end] > start:
            end = int(heads[end])
        out.append((start, end))
        if end >= n:
            break
        back = stride
        if back <= 0 and piece_stride > 0:
            back = end - max(start, int(np.searchsorted(alone, alone[end] - piece_stride, "right")) - 1)
        start = max(start + 1, end - back)
    return out


def fair_windows(items: DataFrame, labelled: DataFrame, max_length: int, specials: int = 2, window: int = 0, stride: int = 0, piece_stride: int = 0) -> DataFrame:
    """The same windows of tokens for every strategy: (doc_id, strategy, chunk_index, word_start, word_end, n_pieces, places).

    items (doc_id, strategy, pos, src, role, pieces) must have all tokens under each strategy, else the query fails; labelled
    (doc_id, tok_idx, label) gives canonical labels. One document is planned at a time, all its strategies together.
    """
    usable = max_length - specials
    if usable <= 0:
        raise ValueError("max_length leaves no room for content")
    if piece_stride >= usable:
        raise ValueError(f"piece_stride must be below the {usable} pieces that a window has room for")
    codes = F.create_map(*(F.lit(x) for r, k in (*ROLES.items(), ("coord_suffix", SUFFIX)) for x in (r, k)))
    role = F.coalesce(codes[F.col("role")], F.lit(OTHER))
    # labels come as one more sequence of the document, before its strategies
    rows = items.select("doc_id", "strategy", "pos", F.coalesce("src", F.lit(-1)).cast("int").alias("src"), role.cast("int").alias("role"), F.col("pieces").cast("int").alias("pieces"), F.lit(None).cast("string").alias("label"))
    zero = F.lit(0)
    rows = rows.unionByName(labelled.select("doc_id", F.lit("").alias("strategy"), F.col("tok_idx").cast("int").alias("pos"), F.col("tok_idx").cast("int").alias("src"), zero.alias("role"), zero.alias("pieces"), F.coalesce("label", F.lit("O")).alias("label")))

    def work(key: tuple, group: pa.Table) -> list:
        group = group.combine_chunks()
        out: list[list] = [[] for _ in range(6)]
        names = group.column("strategy").combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        starts = [names.dictionary[int(codes[a])].as_py() for a in cuts[:-1]]
        n = cuts[1] if starts[0] == "" else 0
        if starts == [""]:
            return out
        src, role, pieces = (group.column(c).to_numpy().astype(np.int64) for c in ("src", "role", "pieces"))
        try:
            if not np.array_equal(src[:n], np.arange(n)):
                raise ValueError("incomplete OCR source coverage")
            views = {name: Emission(src[a:b], role[a:b], pieces[a:b], n) for name, a, b in zip(starts, cuts[:-1], cuts[1:], strict=True) if name}
        except ValueError as e:
            raise ValueError(f"document {key[0]}: {e}") from None
        labels = group.column("label").combine_chunks().slice(0, n)
        plan = plan_windows(list(views.values()), entity_heads(labels), usable, window, stride, piece_stride)
        for chunk, (a, b) in enumerate(plan):
            for name, view in views.items():
                places = view.window(a, b)
                for column, value in zip(out, (name, chunk, a, b, int(view.pieces[places].sum()), places.tolist()), strict=True):
                    column.append(value)
        return out

    return map_tables(rows, ["doc_id"], ["strategy", "pos"], work, "strategy string, chunk_index int, word_start int, word_end int, n_pieces int, places array<int>")


def examples(windows: DataFrame, items: DataFrame, tokens: DataFrame, hide_layout: tuple[str, ...] = ("plain_text",)) -> DataFrame:
    """Windows as rows of items: text, label repaired at the window's begin, gold label, box on the scale of 1000, its mask and page.

    items must have strategy, text and label. Strategies in ``hide_layout`` get neither boxes nor pages; layout items have none.
    """
    box = S.normal_box()
    facts = tokens.select("doc_id", F.col("tok_idx").alias("src"), "page", *(v.alias(f"n_{k}") for k, v in box.items()))
    rows = windows.select("doc_id", "strategy", "chunk_index", "word_start", F.posexplode("places").alias("k", "pos"))
    rows = rows.join(items.select("doc_id", "strategy", "pos", "text", "src", "role", "label"), ["doc_id", "strategy", "pos"]).join(facts, ["doc_id", "src"], "left")
    by = Window.partitionBy("doc_id", "strategy", "chunk_index").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("src").isNotNull(), F.col("label")), ignorenulls=True).over(by)
    entity = S.bio_entity(F.col("label"), True)
    goes_on = (S.bio_prefix(F.col("label"), True) == "I") & S.bio_entity(before, True).eqNullSafe(entity)
    label = F.when(F.col("src").isNull(), None).when(entity.isNull(), "O").otherwise(S.bio(F.when(goes_on, "I").otherwise("B"), entity))
    hidden = F.col("strategy").isin(*hide_layout)
    valid = ~hidden & F.coalesce((F.col("n_x1") >= F.col("n_x0")) & (F.col("n_y1") >= F.col("n_y0")), F.lit(False))
    sides = {f"n_{s}": F.when(valid, F.col(f"n_{s}")).otherwise(0) for s in box}
    rows = rows.withColumn("label", label).withColumns(sides | {"box_mask": valid.cast("int"), "page": F.when(hidden, -1).otherwise(F.coalesce("page", F.lit(-1)))})
    return rows.withColumn("src", F.coalesce("src", F.lit(-1)))


def layout_features(made: DataFrame) -> DataFrame:
    """Examples with what a layout model reads: sides from 0 to 1 (0 where they are masked) and the page as (page + 1) / 256, 0 without one."""
    sides = {f"f_{s}": F.greatest(F.lit(0), F.least(F.lit(1000), F.col(f"n_{s}"))) / 1000.0 * F.col("box_mask") for s in ("x0", "y0", "x1", "y1")}
    page = F.when(F.col("page") >= 0, (F.least(F.lit(255), F.col("page")) + 1) / 256.0).otherwise(0.0)
    return made.withColumns(sides | {"f_page": page})


def tokenizer_pieces(items: DataFrame, path: str) -> DataFrame:
    """Items with ``pieces``: into how many tokens a tokenizer's JSON file cuts each text, one at least. The file goes to all as a
    broadcast; equal texts of a batch are cut once."""
    with open(path, "rb") as file:
        shipped = items.sparkSession.sparkContext.broadcast(file.read())
    names = items.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        cut = Tokenizer.from_buffer(shipped.value)
        for batch in batches:
            coded = batch.column(at).fill_null("").dictionary_encode()
            counts = np.array([max(1, len(e.ids)) for e in cut.encode_batch(coded.dictionary.to_pylist(), add_special_tokens=False)], np.int32)
            pieces = counts[coded.indices.to_numpy(zero_copy_only=False)] if len(counts) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces)], [*names, "pieces"])

    return map_arrow(items, run, T.StructType([*items.schema.fields, T.StructField("pieces", T.IntegerType())]))


def chunk_summary(windows: DataFrame) -> DataFrame:
    """One row: chunks, documents, and the mean and largest number of words of a chunk."""
    words = F.col("word_end") - F.col("word_start")
    return windows.agg(F.count("*").alias("n_base_word_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.coalesce(F.avg(words), F.lit(0.0)), 6).alias("mean_base_chunk_words"), F.coalesce(F.max(words), F.lit(0)).alias("max_base_chunk_words"))


def effective_length(max_length: int, limit: int | None) -> int:
    """The length of a model's input: as set, or as its tokenizer limits it; a limit above a million is none."""
    return max_length if limit is None or limit > 1_000_000 else min(max_length, limit)


def tokenization_summary(made: DataFrame, docs: DataFrame, model: str, max_length: int, specials: int = 2, piece_stride: int = 0) -> DataFrame:
    """One row for each data set and strategy of fair windows: chunks, documents, mean and largest number of subtokens with the
    special ones, and what padding to ``max_length`` comes to. docs (doc_id, dataset_name)."""
    rows = made.join(docs.select("doc_id", "dataset_name"), "doc_id")
    n = F.col("n_pieces") + specials
    total = rows.groupBy("dataset_name", "strategy").agg(F.count("*").alias("n_base_word_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(n), 6).alias("mean_subtokens"), F.max(n).alias("max_subtokens"))
    return total.select(
        "dataset_name", "strategy", F.lit(model).alias("model_name"), F.lit(max_length).alias("effective_max_length"), F.lit(piece_stride).alias("tokenizer_stride"), "n_base_word_chunks",
        F.col("n_base_word_chunks").alias("n_tokenized_chunks"), "n_docs", "mean_subtokens", "max_subtokens", (F.col("n_base_word_chunks") * max_length).alias("total_padded_subtokens"),
    )


def with_pieces(rows: DataFrame, keys: list[str], max_length: int, specials_before: int = 1, specials_after: int = 1) -> DataFrame:
    """Words as a model's positions: rows (keys, k, pieces, label, src, ...) -> a row for each piece with ``position`` from
    ``specials_before`` on. The first piece carries label and src, the rest null and -1; what doesn't fit ``max_length`` is cut."""
    by = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("pieces").over(by), F.lit(0)) + specials_before
    each = rows.withColumn("base", base).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    first = F.col("piece") == 0
    each = each.withColumns({"position": (F.col("base") + F.col("piece")).cast("int"), "label": F.when(first, F.col("label")), "src": F.when(first, F.col("src")).otherwise(-1)})
    return each.where(F.col("position") < max_length - specials_after).drop("base", "pieces")


def canonical_labels(items: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, label) from written items: labels by token, valid BIO in canonical order; tokens that aren't there are O."""
    real = items.where("src is not null and label is not null").groupBy("doc_id", F.col("src").alias("tok_idx")).agg(F.max_by("label", "pos").alias("label"))
    last = items.groupBy("doc_id").agg(F.max("src").alias("m")).where("m is not null")
    every = last.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("tok_idx"))
    rows = every.join(real, ["doc_id", "tok_idx"], "left").withColumn("label", F.coalesce("label", F.lit("O")))
    return repair(rows, "label", ("doc_id",), "tok_idx")
