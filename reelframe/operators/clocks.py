"""Clocks of packets: counters of 33 bits that wrap any number of times, and the rates between their stamps.

stamps: file, number (0, 1, ... in order), clock (ticks, below the counter's size), at (byte position). A clock that falls by
over half the counter has wrapped; a smaller fall is a stamp out of order, and none is a repeated one. Null clocks are
left out first. Numbers are worked in blocks (see blocks.py), so a stream of any length is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators.blocks import WIDTH, running

#: Bits of a time stamp, ticks a second of stamps and of the system clock, which counts 300 times as fast.
BITS, TICKS, SYSTEM = 33, 90_000, 27_000_000


def previous(rows: DataFrame, keys: list[str], number: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """Adds before_<c>: the column in the row before; the first row of a block takes it from the last one of the block before."""
    own = rows.withColumn("__block", F.floor(F.col(number) / width))
    ends = own.groupBy(*keys, "__block").agg(F.max_by(F.struct(*columns), number).alias("__end"))
    over = Window.partitionBy(*keys).orderBy("__block")
    ends = ends.select(*keys, "__block", F.lag("__end").over(over).alias("__end"))
    inside = Window.partitionBy(*keys, "__block").orderBy(number)
    joined = own.withColumn("__last", F.lag(F.struct(*columns)).over(inside)).join(ends, [*keys, "__block"])
    return joined.withColumns({f"before_{c}": F.coalesce("__last", "__end")[c] for c in columns}).drop("__block", "__end", "__last")


def unwrapped(stamps: DataFrame, period: int = 1 << BITS, width: int = WIDTH) -> DataFrame:
    """stamps with `time`: the clock with all wraps before it added, and `wraps`."""
    known = stamps.filter("clock IS NOT NULL")
    steps = previous(known, ["file"], "number", ["clock"], width)
    down, up = F.col("before_clock") - F.col("clock") > period // 2, F.col("clock") - F.col("before_clock") > period // 2
    # A late stamp from before a wrap takes that wrap back; the next one brings it again.
    wrap = F.when(down, 1).when(up, -1).otherwise(0)
    counted = running(steps.withColumn("wrap", wrap), ["file"], "number", {"earlier": F.col("wrap").cast("long")}, width)
    wraps = F.col("earlier") + F.col("wrap")
    return counted.withColumn("wraps", wraps).withColumn("time", F.col("clock") + wraps * F.lit(period)).drop("before_clock", "wrap", "earlier")


def rates(stamps: DataFrame, period: int = (1 << BITS) * 300, ticks: int = SYSTEM, width: int = WIDTH) -> DataFrame:
    """Every step between two stamps in order: file, number, ms and bytes since the one before, bit_rate (null for a repeated or earlier stamp)."""
    steps = previous(unwrapped(stamps, period, width), ["file"], "number", ["time", "at"], width).filter("before_time IS NOT NULL")
    ms = (F.col("time") - F.col("before_time")).cast("double") * 1000 / ticks
    size = F.col("at") - F.col("before_at")
    return steps.select("file", "number", ms.alias("ms"), size.alias("bytes"), F.when((F.col("time") > F.col("before_time")) & (size > 0), F.round(size.cast("double") * 8000 / ms).cast("long")).alias("bit_rate"))


def spans(stamps: DataFrame, period: int = (1 << BITS) * 300, ticks: int = SYSTEM, width: int = WIDTH) -> DataFrame:
    """A file's first and last stamp by number: file, delay and duration in ms, bytes, bit_rate, wraps, repeated (stamps equal to the one before)."""
    times = previous(unwrapped(stamps, period, width), ["file"], "number", ["time"], width)
    place = F.struct("time", "at")
    ends = times.groupBy("file").agg(F.min_by(place, "number").alias("a"), F.max_by(place, "number").alias("z"), F.max("wraps").alias("wraps"), F.count_if(F.col("time") == F.col("before_time")).alias("repeated"))
    ms = (F.col("z.time") - F.col("a.time")).cast("double") * 1000 / ticks
    size = F.col("z.at") - F.col("a.at")
    whole = (ms > 0) & (size > 0)
    return ends.select("file", (F.col("a.time").cast("double") * 1000 / ticks).alias("delay"), F.when(whole, ms).alias("duration"), F.when(whole, size).alias("bytes"), F.when(whole, F.round(size.cast("double") * 8000 / ms).cast("long")).alias("bit_rate"), "wraps", "repeated")
