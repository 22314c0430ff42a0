"""What several operators of this subpackage share: tables, the shared folder, ids as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import importlib
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session that names none takes its warehouse's."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of files, and of rows, that one partition of a result or a checkpoint holds, about, beyond two of each core.
FILE_BYTES = 1 << 26


def _merged(df: DataFrame, size: int) -> DataFrame:
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))


def cut(df: DataFrame, size: int | None = None) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder.

    With ``size`` (bytes, about) partitions are merged first, so that a small table is not kept in hundreds of files.
    """
    shared_dir(df.sparkSession)
    return (df if size is None else _merged(df, size)).checkpoint()


#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, where the session doesn't say otherwise: long texts fill batches of 10,000 rows
    with tens of megabytes, which the JVM and the worker hold several times over."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def merged_like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows made of ``docs`` in as many partitions as the size of its files asks for, two of each core at least.

    Tables that are no files, whose size Spark doesn't know, keep their partitions.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return _merged(df, size) if size < 1 << 60 else df


_FREED_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, what a query has shuffled is deleted as it ends, not when the driver happens to collect its garbage.

    For tables built and run once within, as ``cut`` does; those built after it are as before.
    """
    before = spark.conf.get(_FREED_SETTING, None)
    spark.conf.set(_FREED_SETTING, True)
    try:
        yield
    finally:
        spark.conf.unset(_FREED_SETTING) if before is None else spark.conf.set(_FREED_SETTING, before)


def drawn(share: Column, *parts: Column) -> Column:
    """Whether a row is in a sample of about this share (0 to 1) of all rows, by a 64-bit digest of its parts."""
    return F.xxhash64(*parts).cast("double") / 2.0**64 + 0.5 < share


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers, the default of the path parameters."""
    return importlib.import_module("public_tokenizers").path(name)


def single_threaded() -> None:
    """Keep native libraries to the one core that Spark gave the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes; a longer text makes a run of its own."""
    so_far = np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64).cumsum()])
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(so_far, so_far[at] + size, side="right")) - 1)
        yield texts.slice(at, until - at)
        at = until


def fresh_worker() -> None:
    """Drop what tasks of another operator may have left in this Python worker, which Spark uses again."""
    for name, clear in (("wordbpe", "release"), ("bytebpe", "release")):
        if module := sys.modules.get(f"leafscan.llm.{name}"):
            getattr(module, clear)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library can, freed memory goes back to the system
        ctypes.CDLL(None).malloc_trim(0)


def by_text(docs: DataFrame, keep: tuple[str, ...], judge: Callable[[], Callable[[pa.Array], list[pa.Array]]], made: str) -> tuple[DataFrame, list[Column]]:
    """Rows of ``docs`` with what a function of their texts gives, in columns of their own names, and the kept columns.

    ``judge()`` is called once a task and gives a function from a run of texts (about a megabyte) to the columns
    that ``made`` describes.  The text travels once, also where it is kept; no kept name can clash with another.
    """
    own = {"text": F.col("text").cast("string")}
    kept = []
    for k, name in enumerate(keep):
        once = name == "text" and isinstance(docs.schema[name].dataType, T.StringType)
        kept.append(F.col("text" if once else f"kept_{k}").alias(name))
        if not once:
            own[f"kept_{k}"] = F.col(f"`{name}`")
    carried = docs.select(*[c.alias(n) for n, c in own.items()])
    schema = T.StructType([*carried.schema.fields, *T.StructType.fromDDL(made).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        judged = judge()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0), 1 << 20):
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *judged(texts)], names=schema.names)

    return carried.mapInArrow(rows, schema), kept
