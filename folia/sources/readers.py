"""Readers of delivered files: CSV splits, JSON lines, folders of JSON, and written records."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, types as T
from pyspark.sql import functions as F

from folia.operators.records import with_slots
from folia.session import guard, map_arrow

# Names under which columns may be delivered, in order of preference.
COLUMNS = {
    "doc_id": ["doc_id", "id", "original_filename", "filename", "file_name", "pdf_name"],
    "text": ["text", "raw_text", "ocr_text", "document_text"],
    "labels": ["labels", "Labels", "annotations", "Annotations"],
    "ocr_json": ["OCR", "ocr_json", "ocr_output", "ocr_data"],
    "ocr_path": ["ocr", "ocr_path", "ocr_file", "ocr_filename"],
    "image_files": ["image_files", "images", "page_images"],
}
# Data sets and their folders; those without one can be loaded but aren't read by default.
DATASETS = {"fcc_invoices": "fcc_invoices", "ndas": "nda", "charity_reports": "charities"}
LOADABLE = [*DATASETS, "resource_contracts", "sec_s1"]
# Label spellings of single data sets that stand for another, besides those of all.
LABEL_MAPS: dict[str, dict[str, str]] = {}


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by number, and their names before: they may differ in case only (OCR and ocr)."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), {c: f"c{k}" for k, c in enumerate(df.columns)}


def first_present(columns: dict[str, str], kind: str, names: dict[str, list[str]] | None = None) -> Column:
    """The first of a kind's columns that the table has (see numbered) and that isn't missing in the row; NaN and empty texts are missing."""
    found = [columns[c] for c in (names or COLUMNS)[kind] if c in columns]
    values = [F.when(~F.col(c).cast("string").isin("", "NaN", "nan"), F.col(c).cast("string")) for c in found]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def csv_split(spark: SparkSession, root: str, dataset: str, folder: str, split: str) -> DataFrame:
    """One CSV file with its data set, folder, split and row numbers from 0. Values stay text; quoted ones may span lines."""
    raw = spark.read.csv(f"{root}/{folder}/{split}.csv", header=True, multiLine=True, escape='"')
    # values with line breaks make the file one partition, in which the id is the row's number
    return raw.withColumns({"dataset": F.lit(dataset), "source_folder": F.lit(folder), "source_split": F.lit(split), "source_row_index": F.monotonically_increasing_id()})


def csv_splits(spark: SparkSession, root: str, datasets: dict[str, str] | None = None, splits: tuple[str, ...] = ("train", "val", "test")) -> tuple[DataFrame | None, DataFrame]:
    """(all rows, load status): files that can't be read are reported and left out."""
    frames, status = [], []
    for dataset, folder in (datasets or DATASETS).items():
        for split in splits:
            try:
                frame = csv_split(spark, root, dataset, folder, split)
                status.append((dataset, folder, split, "ok"))
                frames.append(frame)
            except AnalysisException as error:
                status.append((dataset, folder, split, f"error: {error.getCondition() or type(error).__name__}"))
    rows = None
    for frame in frames:
        rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)
    return rows, spark.createDataFrame(status, "dataset string, folder string, source_split string, status string")


def json_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, line_no from 1, value): the lines of text files, gzipped or not, without blank ones.

    Plain files are read in splits by many tasks. A line's number is its place in its split and the lines of the splits before,
    which are counted first; a gzipped file is one split. ``glob``: names to be read, at any depth below the path.
    """
    guard(spark)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob) if glob else spark.read
    files = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start")
    lines = reader.text(path).select(*files, F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("value"))
    splits = lines.groupBy("path", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.join(splits.select("path", "__start", "__first", before.alias("__before")), ["path", "__start"])
    return rows.where(F.trim("value") != "").select("path", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_no"), "value")


def json_folder(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source_line_number, value): each record of the JSON files below a folder as text.

    A .json file holds an object (no number) or a list (numbers from 0); .jsonl files hold one on each line (from 1), and are
    read in splits; either may end in .gz. Unreadable content fails the query and tells the file and line.
    """
    lines = json_lines(spark, path, glob="*.{jsonl,jsonl.gz}").select(F.col("path").alias("source_path"), F.col("line_no").alias("k"), "value")
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,json.gz}").text(path, wholetext=True)
    whole = whole.select(F.col("_metadata.file_path").alias("source_path"), "value")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    lists = whole.where(is_list).select("source_path", F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("k", "value"))
    single = whole.where(~is_list).select("source_path", F.lit(None).cast("bigint").alias("k"), "value")
    rows = lines.unionByName(lists.withColumn("k", F.col("k").cast("bigint"))).unionByName(single)
    where = F.concat(F.col("source_path"), F.coalesce(F.concat(F.lit(":"), F.col("k").cast("string")), F.lit("")))
    parsed = F.to_json(F.try_parse_json("value"))
    good = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("malformed JSON in "), where)).cast("string")).otherwise(parsed)
    return rows.select("source_path", F.col("k").alias("source_line_number"), good.alias("value"))


def json_by_path(rows: DataFrame, path_col: str, root: str) -> DataFrame:
    """Rows with ``payload``, the content of the file that a column names relative to ``root``; gzip is read as such.

    Only the files named are opened, by the task that has the row, on any file system that the executors reach.
    Rows without path, or whose file isn't there, have null.
    """
    names = rows.columns
    at = names.index(path_col)
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(base if ":/" in base else f"file://{base}")
        for batch in batches:
            out = []
            for name in batch.column(at).to_pylist():
                full = f"{folder}/{name}"
                if name is None or system.get_file_info(full).type != fs.FileType.File:
                    out.append(None)
                    continue
                with system.open_input_stream(full, compression="detect") as file:
                    out.append(file.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "payload"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("payload", T.StringType())]))


def write_texts(rows: DataFrame, root: str) -> int:
    """Write rows (path, content) as files below ``root``, gzipped where the path ends in .gz; each task writes its own. The number of files."""
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(base if ":/" in base else f"file://{base}")
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = f"{folder}/{name}"
                system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(full, compression="gzip" if name.endswith(".gz") else None) as file:
                    file.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return map_arrow(rows.select("path", "content"), run, "path string").count()


RECORD_SCHEMA = (
    "id string, doc_id string, doc_key string, metadata map<string,string>, original_token_count int, tokens array<string>, labels array<string>, original_token_labels array<string>, loss_mask array<boolean>, "
    "source_token_indices array<int>, layout_roles array<string>, item_attrs array<map<string,string>>, pages array<int>, bboxes array<array<int>>, normalized_bboxes array<array<int>>, "
    "offsets array<array<int>>, serialized_token_count int"
)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders right below a folder, from its listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()) if system.exists(path) else []


def record_folders(spark: SparkSession, root: str, datasets: list[str] | None = None, strategies: list[str] | None = None) -> list[tuple[str, str, str]]:
    """(data set, strategy, folder) of written records, found by listing: folders ``[dataset=]<name>/[serializer=]<name>``.
    A data set that isn't there fails, a strategy doesn't."""
    value = lambda name: unquote(name.split("=", 1)[-1])
    found = {value(d): d for d in folders(spark, root)}
    if any(d.startswith("serializer=") for d in found.values()):  # written the other way round
        pairs = [(value(d), value(s), f"{root}/{s}/{d}") for s in found.values() for d in folders(spark, f"{root}/{s}")]
        found = {d: d for d, _, _ in pairs}
    else:
        pairs = [(d, value(s), f"{root}/{name}/{s}") for d, name in found.items() for s in folders(spark, f"{root}/{name}")]
    lack = set(datasets or ()) - set(found)
    if lack:
        raise ValueError(f"no records of {', '.join(sorted(lack))}")
    return [p for p in pairs if (not datasets or p[0] in datasets) and (not strategies or p[1] in strategies)]


def records(spark: SparkSession, root: str, datasets: list[str] | None = None, strategies: list[str] | None = None) -> DataFrame:
    """Written records of data sets and strategies, all by default (see record_folders). Only their folders are read; a broken
    line fails the query and tells file and line."""
    found = record_folders(spark, root, datasets, strategies)
    if not found:
        return spark.createDataFrame([], f"{RECORD_SCHEMA}, dataset string, serializer string, source_path string, source_line_number bigint")
    names = spark.createDataFrame(found, "dataset string, serializer string, __folder string")
    lines = json_lines(spark, [f for _, _, f in found])
    read = F.from_json("value", f"{RECORD_SCHEMA}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r")
    rows = lines.select("path", "line_no", read)
    message = F.concat(F.lit("malformed record in "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    rows = rows.withColumn("r", F.when(F.col("r.__broken").isNotNull(), F.raise_error(message).cast(rows.schema["r"].dataType)).otherwise(F.col("r")))
    # a file is known by the last two folders that it is in
    last = lambda c, skip: F.array_join(F.slice(F.split(c, "/"), -2 - skip, 2), "/")
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    rows = rows.withColumn("__at", last(plain, 1)).join(names.select("dataset", "serializer", last("__folder", 0).alias("__at")), "__at")
    return rows.select("r.*", "dataset", "serializer", F.col("path").alias("source_path"), F.col("line_no").alias("source_line_number")).drop("__broken")


def items_of(rows: DataFrame) -> DataFrame:
    """Written records as items again: (doc_id, strategy, pos, text, src, role, label); label null for layout items.

    Records of older form may lack sources or roles, or have others than items: then items with a label are tokens, numbered in
    order, and the others layout. As many labels as tokens are needed, else the query fails. Of several records of one key, those after
    the first have their number at its end.
    """
    rows = with_slots(rows)
    rows = rows.withColumn("doc_key", F.when(F.col("occurrence") == 0, F.col("doc_key")).otherwise(F.concat("doc_key", F.lit("#"), "occurrence")))
    n = F.size("tokens")
    missing = lambda x: x.isNull() | (x == "-100")
    short = F.when(F.coalesce(F.size("labels"), n) != n, F.raise_error(F.concat(F.lit("record has other numbers of tokens and labels: "), F.col("doc_key"))))
    real = F.transform("labels", lambda x: F.when(missing(x), 0).otherwise(1))
    counted = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(F.element_at(real, k) == 1, F.aggregate(F.slice(real, F.lit(1), k), F.lit(-1), lambda a, b: a + b)))
    known = lambda c: F.coalesce(F.size(c) == n, F.lit(False))
    sources = F.when(known("source_token_indices"), F.col("source_token_indices")).when(n > 0, counted)
    rows = rows.withColumn("source_token_indices", sources).withColumn("labels", F.when(F.lit(True) & short.isNull(), F.col("labels")))
    columns = {"tokens": "text", "source_token_indices": "src", "layout_roles": "role", "labels": "label"}
    zipped = F.arrays_zip(*(F.coalesce(c, F.array()).alias(c) for c in columns))
    each = rows.select(F.col("doc_key").alias("doc_id"), F.col("serializer").alias("strategy"), known("layout_roles").alias("roles"), F.posexplode(zipped).alias("pos", "i"))
    src = F.col("i.source_token_indices")
    role = F.coalesce(F.when(F.col("roles"), F.nullif(F.col("i.layout_roles"), F.lit(""))), F.when(src.isNull(), "layout").otherwise("ocr_token"))
    label = F.when(~missing(F.col("i.labels")), F.col("i.labels"))
    return each.select("doc_id", "strategy", "pos", F.col("i.tokens").alias("text"), src.alias("src"), role.alias("role"), label.alias("label"))
