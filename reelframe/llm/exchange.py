"""An exchange of packed hash arrays: which hashes occur in other chunks of the corpus, told to each chunk again.

A map task packs the hashes of its texts into one row per bucket (a range of the hash space). Rows of a bucket meet in
one task, which answers each row by a row for the same chunk; the answers of a chunk then meet its own payload row
(bucket -1). A hash is sent at most a fixed number of times per chunk, so however many texts share it, no bucket gets
more than that from each task. Rows are never fewer than the entries need, so many small blocks cost no more than a
row per entry would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelframe.llm.common import release, spread

ROW = "chunk string, bucket int, a binary, b binary, c binary"
NAMES = ["chunk", "bucket", "a", "b", "c"]
Answer = tuple[str, int, bytes, bytes, bytes]


def batch_of(rows: list[Answer]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], NAMES)


def bucket_rows(chunk: str, buckets: int, keys: np.ndarray, *values: np.ndarray) -> list[Answer]:
    """Rows of rising uint64 keys and aligned values, cut by bucket."""
    bucket = bucket_of(keys, buckets)
    used, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(keys))
    return [(chunk, int(k), planes(keys[i:j]), *(values[n][i:j].tobytes() if n < len(values) else b"" for n in range(2))) for k, i, j in zip(used, first, ends, strict=True)]


def planes(keys: np.ndarray) -> bytes:
    """Rising uint64 keys as eight planes of bytes: the high ones repeat, so that the exchange's compression shrinks them."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of rows with one key, from batches that are sorted by it."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 64):
                yield from batch.slice(piece, 64).to_pylist()

    for k, own in groupby(rows(), lambda r: r[key]):
        yield k, list(own)
    release()


def meeting(packed: DataFrame, parts: int) -> DataFrame:
    """The rows of each bucket side by side in one task, in rising order of buckets and chunks. packed: ROW rows and home."""
    return packed.repartition(parts, "bucket", "home").sortWithinPartitions("bucket", "chunk").select(*NAMES)


def answered(packed: DataFrame, answer: Callable[[list[dict]], Iterator[Answer]], assemble: Callable[[str, dict | None, list[dict]], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """packed: ROW rows. answer: the rows of one bucket to answers. assemble: a chunk, its payload row, its answers.

    parts: tasks of each exchange.
    """
    return told(meeting(packed, parts), answer, assemble, schema, parts)


def told(met: DataFrame, answer: Callable[[list[dict]], Iterator[Answer]], assemble: Callable[[str, dict | None, list[dict]], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """answered() from rows that have met."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            if bucket < 0:
                for r in rows:
                    yield batch_of([tuple(r[n] for n in NAMES)])
            else:
                out = list(answer(rows))
                for i in range(0, len(out), 256):
                    yield batch_of(out[i : i + 256])

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in grouped(batches, "chunk"):
            payload = next((r for r in rows if r["bucket"] < 0), None)
            yield from assemble(chunk, payload, [r for r in rows if r["bucket"] >= 0])

    return met.mapInArrow(reduce, ROW).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(regroup, schema)


def homed(packed: DataFrame) -> DataFrame:
    """With the column that spreads payload rows over tasks; bucket rows have none."""
    from pyspark.sql import functions as F

    return packed.withColumn("home", F.when(F.col("bucket") < 0, F.col("chunk")).otherwise(F.lit("")))


def chunk_name(number: int) -> str:
    """A name that the same task gives its chunks whenever it runs again."""
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId()}-{number}"


def buckets_for(df: DataFrame) -> int:
    return 4 * spread(df)


def unpack(value: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(value, kind)
