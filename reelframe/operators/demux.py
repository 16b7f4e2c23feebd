"""Transport packets put together to units, per file and packet id, with continuity counters; the same rules in batch and as a stream.

packets: file, pid, number (order in the file), counter (0 to 15), start (a unit begins), payload (binary). Packets with no
number or payload are left out. A packet with the counter and payload of the one before is a repetition and is dropped; any other
counter than the next one is a gap, counted for the packet's unit. What comes before a pid's first start belongs to no unit.

Rows: file, pid, unit (from 1), first (number of its first packet), packets, gaps, closed (another start follows), data. `units`
works in blocks of packets (see blocks.py); a unit's bytes meet in one task, as they are one value of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.blocks import WIDTH, running
from reelframe.operators.clocks import previous

#: A fixed value: the counter's period.
COUNTERS = 16
UNIT = "unit long, first long, packets long, gaps long, closed boolean, data binary"


def used(packets: DataFrame) -> DataFrame:
    return packets.filter("number IS NOT NULL AND payload IS NOT NULL").select("file", "pid", F.col("number").cast("long").alias("number"), F.col("counter").cast("int").alias("counter"), F.coalesce("start", F.lit(False)).alias("start"), F.col("payload").cast("binary").alias("payload"))


def joined(parts: Column) -> Column:
    """Binary parts, in order, as one value."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def units(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    keys = ["file", "pid"]
    own = used(packets).withColumn("digest", F.sha2("payload", 256))
    near = previous(own, keys, "number", ["counter", "digest"], width)
    repeated = F.col("before_counter").eqNullSafe(F.col("counter")) & F.col("before_digest").eqNullSafe(F.col("digest"))
    gap = F.col("before_counter").isNotNull() & ~((F.col("before_counter") + 1) % COUNTERS).eqNullSafe(F.col("counter"))
    kept = near.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("long")).filter(~repeated).drop("before_counter", "before_digest", "digest")
    begun = running(kept, keys, "number", {"earlier": F.col("start").cast("long")}, width).withColumn("unit", F.col("earlier") + F.col("start").cast("long"))
    last = begun.groupBy(*keys).agg(F.max("unit").alias("last"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("number", "payload"))), lambda x: x["payload"])
    found = begun.filter("unit > 0").groupBy(*keys, "unit").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("packets"), F.sum("gap").alias("gaps"), joined(parts).alias("data"))
    return found.join(last, keys).select(*keys, "unit", "first", "packets", "gaps", (F.col("unit") < F.col("last")).alias("closed"), "data")
