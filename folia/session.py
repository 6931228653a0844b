"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "folia", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` takes further settings with ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it as read from there.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) a local one is made.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for what jobs write in between, set up if it isn't yet; see cut_lineage."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folia-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the checkpoint folder, for files that a query writes and reads."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def guard(spark: SparkSession) -> None:
    """Unions don't pass on their inputs' partitioning: where adaptive execution has merged partitions of the inputs in
    different ways, groups above such a union come apart (seen with Spark 4.1.2)."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", None) != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    guard(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once for an application, so that it needn't be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not itself read from a zip file
        shared = urlparse(spark.conf.get("spark.checkpoint.dir", None) or "")
        base = Path(shared.path) / "packages" if shared.path and shared.scheme in ("", "file") else None
        if base is not None:
            base.mkdir(parents=True, exist_ok=True)
        folder = Path(tempfile.mkdtemp(prefix="folia-", dir=base))  # the driver reads it from there and serves it
        with zipfile.ZipFile(folder / "folia.zip", "w", zipfile.ZIP_DEFLATED) as file:
            for path in sorted(root.rglob("*.py")):
                file.write(path, path.relative_to(root.parent))
        context.addPyFile(str(folder / "folia.zip"))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with the package on the executors."""
    guard(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)
