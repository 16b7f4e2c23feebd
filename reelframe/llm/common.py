"""Helpers that the operators share: shared-storage checkpoints, ragged numpy gathers, text batches, label folds."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut into pieces of about this many text bytes, so that numpy temporaries stay small.
PIECE_BYTES = 1 << 20
#: Input bytes that one task of an exchange should see.
TASK_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df once to spark.checkpoint.dir and go on from there, so that lost executors cost no recomputation.

    The folder is the session's, shared by all executors; only a local session without one gets a temporary folder. The
    shuffles that df needed are removed when the checkpoint stands, so an operator's disk is that of its largest step.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting counts for plans made while it is on
    finally:
        spark.conf.set(_CLEANUP, before)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and checkpoints that df reads; other leaves of its plan count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    total = 0
    for leaf in (leaves.apply(k) for k in range(leaves.size())):
        if "Relation" in leaf.nodeName():
            total += int(str(leaf.stats().sizeInBytes()))
        elif leaf.getClass().getSimpleName() == "LogicalRDD":
            total += _checkpoint_bytes(df.sparkSession, leaf.rdd())
    return total


def _checkpoint_bytes(spark: SparkSession, rdd) -> int:
    """Bytes of a checkpoint's files; a leaf that isn't checkpointed has none. The plan's own estimate multiplies the sides of joins."""
    kept = rdd.getCheckpointFile()
    if kept.isEmpty():
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.get())
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def spread(df: DataFrame) -> int:
    """The number of tasks that an exchange of df should have: the session's, and more where the input asks for more."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 17, math.ceil(input_bytes(df) / TASK_BYTES)))


def release() -> None:
    """Give what a task's temporaries took back to the system; called when a task has read its last batch."""
    from reelframe.llm import textstats

    textstats.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of doc_id as text modulo parts; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about limit text bytes or is a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    release()


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one uint8 array, and the n + 1 offsets into it; null is empty."""
    import pyarrow.compute as pc

    kind = pa.large_binary()
    values = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(kind)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of ragged runs, one run after the other."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - sizes), sizes)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def with_text(documents: DataFrame, *more) -> DataFrame:
    """doc_id, text and the named columns only, so that nothing else is read or sent to Python."""
    return documents.select("doc_id", *more, F.col("text").cast("string").alias("text"))


def numbered(documents: DataFrame) -> DataFrame:
    """All columns and __row, the number that operators give the rows of the same table."""
    return documents.withColumn("__row", F.monotonically_increasing_id())


def only(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose number is in rows (column row)."""
    return numbered(documents).join(rows.select(F.col("row").alias("__row")), "__row", "left_semi").drop("__row")
