"""Computations over ordered samples: rates, sample tables, clocks, packets, and running loudness.

Each is keyed by one file or stream, whose samples are ordered by a window; what a stream can hold is bounded by its
own length, and different streams are independent partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(rows: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Adds delta: time minus the one before."""
    return rows.withColumn("delta", F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(*order)))


def median_rate(rows: DataFrame, key: str, time: str, order: list[str], first: int = 64, unit: float = 1000.0) -> DataFrame:
    """Rate of the upper median of the positive steps among the first sorted stamps, and whether 80 % of the steps are within 5 % of it."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= first)
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.size("times") - 1), lambda i: F.get("times", i) - F.get("times", i - 1)), lambda d: d > 0)
    own = ranked.groupBy(key).agg(F.array_sort(F.collect_list(time)).alias("times")).filter(F.size("times") > 1).withColumn("steps", F.array_sort(steps)).filter(F.size("steps") > 0)
    median = F.get("steps", F.floor(F.size("steps") / 2).cast("int"))
    near = F.size(F.filter("steps", lambda d: F.abs(d - F.col("median")) * 20 <= F.col("median")))
    return own.withColumn("median", median).select(key, "median", (F.lit(unit) / F.col("median")).alias("rate"), (near * 5 >= F.size("steps") * 4).alias("regular"))


def constant_rate(rows: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Whether every step is within one of the first."""
    stepped = deltas(rows, key, time, order).filter("delta IS NOT NULL")
    base = F.first_value("delta").over(Window.partitionBy(key).orderBy(*order))
    return stepped.withColumn("near", F.abs(F.col("delta") - base) <= 1).groupBy(key).agg(F.bool_and("near").alias("constant"), F.count(F.lit(1)).alias("steps"))


def sample_times(rows: DataFrame, key: str, delta: str, order: list[str]) -> DataFrame:
    """Start of each sample: the sum of the deltas before it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(delta).over(before), F.lit(0)))


def as_of(chunks: DataFrame, runs: DataFrame, key: str, chunk: str, first: str, value: str) -> DataFrame:
    """The value of the last run that begins at or before each chunk: one sort of both, no range join."""
    both = chunks.select(key, F.col(chunk).alias("at"), F.lit(None).cast(runs.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    both = both.unionByName(runs.select(key, F.col(first).alias("at"), value, F.lit(0).alias("side")))
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).filter("side = 1").select(key, F.col("at").alias(chunk), value)


def packets(rows: DataFrame, key: str, start: str, order: list[str], payload: str) -> DataFrame:
    """Packets reassembled from parts: a start flag begins one; parts before the first start are dropped."""
    number = F.sum(F.col(start).cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = F.struct(*order, F.col(payload).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["part"]), "")
    return rows.withColumn("packet", number).filter("packet > 0").groupBy(key, "packet").agg(F.count(F.lit(1)).alias("parts"), joined.alias("data"))


def loudness(rows: DataFrame, key: str, level: str, order: list[str]) -> DataFrame:
    """Running mean of levels, rounded at each step as a decoder does, with minimum, maximum and count."""
    levels = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(level).alias("v")))), lambda x: x["v"])
    zero = F.struct(F.lit(0).cast("long").alias("mean"), F.lit(0).cast("long").alias("n"))
    step = lambda s, v: F.struct(F.round((s["mean"] * s["n"] + v).cast("double") / (s["n"] + 1)).cast("long").alias("mean"), (s["n"] + 1).alias("n"))
    return rows.groupBy(key).agg(levels.alias("v"), F.min(level).alias("least"), F.max(level).alias("most"), F.count(level).alias("n")).select(key, F.aggregate("v", zero, step)["mean"].alias("mean"), "least", "most", "n")


def gop(types: str) -> Column:
    """`M=3, N=12` of picture types in order, from the first I picture to the next."""
    rest = F.col(types)
    first = F.instr(rest, "I")
    after = rest.substr(first + 1, F.length(rest))
    n = F.instr(after, "I")
    m = F.least(*(F.when(F.instr(after, k) > 0, F.instr(after, k)) for k in ("I", "P")))
    return F.when((first > 0) & (n > 0), F.concat(F.lit("M="), m.cast("string"), F.lit(", N="), n.cast("string")))


def edit_list(rows: DataFrame, key: str) -> DataFrame:
    """Of edits (duration, media_time): delay of the empty ones, presentation of the others, first media time."""
    empty = F.col("media_time") == -1
    return rows.groupBy(key).agg(F.sum(F.when(empty, F.col("duration")).otherwise(0)).alias("delay"), F.sum(F.when(~empty, F.col("duration")).otherwise(0)).alias("presentation"), F.min(F.when(~empty, F.col("media_time"))).alias("media_start"))


def first_and_last(rows: DataFrame, key: str, time: str, length: str, order: list[str]) -> DataFrame:
    """The first stamp seen, and the end of the latest one; of equal stamps the one seen last gives its length."""
    seen = F.struct(*order)
    latest = F.max_by(F.col(time) + F.col(length), F.struct(F.col(time), *order))
    return rows.groupBy(key).agg(F.min_by(time, seen).alias("first"), latest.alias("last"))


def sample_offsets(samples: DataFrame, chunk: list[str], size: str, order: list[str], start: str) -> DataFrame:
    """Place of each sample: its chunk's start and the sizes of the chunk's samples before it."""
    before = Window.partitionBy(*chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("offset", F.col(start) + F.coalesce(F.sum(size).over(before), F.lit(0)))


def rate_range(rows: DataFrame, key: str, delta: str, order: list[str], unit: float = 1000.0) -> DataFrame:
    """Least and greatest rate of the positive durations, and whether the last one is shorter than all others."""
    numbered = rows.withColumn("__last", F.max_by(delta, F.struct(*order)).over(Window.partitionBy(key))).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))))
    positive = F.when(F.col(delta) > 0, F.col(delta))
    others = F.min(F.when(F.col("__n") > 1, F.col(delta)))
    return numbered.groupBy(key).agg((unit / F.max(positive)).alias("rate_min"), (unit / F.min(positive)).alias("rate_max"), F.coalesce(F.max("__last") < others, F.lit(False)).alias("last_shorter"))


def index_totals(entries: DataFrame, keys: list[str], size: str, scale: int = 1) -> DataFrame:
    """Chunks and scaled bytes of each stream of an index."""
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), (F.sum(size) * scale).alias("bytes"))


def video_delay(streams: DataFrame, file: str, kind: str, delay: str, order: str) -> DataFrame:
    """Each audio stream's delay beside the file's first video stream."""
    video = F.first(F.when(F.col(kind) == "Video", F.col(delay)), ignorenulls=True).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return streams.withColumn("video_delay", F.when(F.col(kind) == "Audio", F.col(delay) - video))


def stream_order(streams: DataFrame, file: str, kind_rank: Column, first: str, *ties: str) -> DataFrame:
    """Streams numbered by kind and then by their first packet."""
    return streams.withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy(kind_rank, first, *ties)) - 1)


def menus(streams: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """A program's streams as one list in order."""
    return streams.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]), " / ").alias("list"))


def chapter_positions(chapters: DataFrame, file: str, time: str, first: int, *ties: str) -> DataFrame:
    """Field positions of a menu's chapters behind the schema's own fields, by time."""
    return chapters.withColumn("pos", F.row_number().over(Window.partitionBy(file).orderBy(time, *ties)) - 1 + first)
