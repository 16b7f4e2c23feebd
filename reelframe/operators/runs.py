"""Sample tables kept as runs: (count, delta) for times and (count, size) for bytes, cut by edit windows in closed form.

No run is exploded: prefix sums give each run's first sample, time and byte, an edge of a window finds its run by an as-of
lookup, and the place within the run is a division. Runs and edges of a file go to tasks in blocks (see blocks.py).

runs: file, run (0, 1, ... in order), n, delta or size; windows: file, window, start and length in milliseconds; scales:
file, timescale. A run of no samples or without time is fine; null counts, deltas and sizes are 0; a missing timescale, or one of 0, is 1. A sample belongs to a
window if its start lies in [start, start + length) less a microsecond; samples without a size have 0 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.operators.blocks import WIDTH, last_before, running

#: A fixed value: edges are this many milliseconds early, which takes up rounding of stamps.
EARLY = 0.001


def _whole(name: str) -> Column:
    return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)).cast("long")


def timed(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """file, run, n, delta, first (samples before) and at (time before)."""
    own = runs.select("file", "run", _whole("n").alias("n"), _whole("delta").alias("delta"))
    return running(own, ["file"], "run", {"first": F.col("n"), "at": F.col("n") * F.col("delta")}, width)


def sized(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """file, run, n, size, first (samples before) and at (bytes before)."""
    own = runs.select("file", "run", _whole("n").alias("n"), _whole("size").alias("size"))
    return running(own, ["file"], "run", {"first": F.col("n"), "at": F.col("n") * F.col("size")}, width)


def samples_before(edges: DataFrame, times: DataFrame, edge: str, width: int = WIDTH) -> DataFrame:
    """edges with `samples`: how many samples start before the time edge. times: of timed."""
    found = last_before(edges, times, ["file"], edge, "at", "run", ["first", "at", "n", "delta"], width)
    past = F.col(edge) - F.col("found.at")
    inside = F.when(F.col("found.delta") > 0, F.least(F.col("found.n"), F.ceil(past / F.col("found.delta")))).otherwise(F.col("found.n"))
    return found.withColumn("samples", F.coalesce(F.col("found.first") + inside, F.lit(0))).drop("found")


def bytes_before(edges: DataFrame, sizes: DataFrame, sample: str, width: int = WIDTH) -> DataFrame:
    """edges with `bytes`: of all samples before the number sample. sizes: of sized."""
    found = last_before(edges, sizes, ["file"], sample, "first", "run", ["first", "at", "n", "size"], width)
    inside = F.least(F.col("found.n"), F.col(sample) - F.col("found.first")) * F.col("found.size")
    return found.withColumn("bytes", F.coalesce(F.col("found.at") + inside, F.lit(0))).drop("found")


def within(windows: DataFrame, runs: DataFrame, sizes: DataFrame, scales: DataFrame, width: int = WIDTH) -> DataFrame:
    """file, window, samples and bytes of each window; a window's two edges are looked up as rows of their own."""
    scale = F.greatest(F.coalesce(F.col("timescale"), F.lit(1)), F.lit(1))
    edge = lambda ms: F.ceil((ms - F.lit(EARLY)) * scale / 1000.0).cast("long")
    placed = windows.join(scales, "file", "left")
    ends = F.array(F.struct(F.lit(-1).alias("sign"), edge(F.col("start")).alias("edge")), F.struct(F.lit(1).alias("sign"), edge(F.col("start") + F.col("length")).alias("edge")))
    edges = placed.select("file", "window", F.explode(ends).alias("x")).select("file", "window", "x.*")
    counted = bytes_before(samples_before(edges, timed(runs, width), "edge", width), sized(sizes, width), "samples", width)
    part = lambda c: F.greatest(F.sum(F.col("sign") * F.col(c)), F.lit(0)).alias(c)
    return counted.groupBy("file", "window").agg(part("samples"), part("bytes"))


def totals(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """file, samples, duration (in the timescale), bytes; the last frame's difference where two runs end in one shorter sample."""
    order = F.col("run")
    time = runs.groupBy("file").agg(
        F.sum(_whole("n")).alias("samples"), F.sum(_whole("n") * _whole("delta")).alias("duration"), F.count(F.lit(1)).alias("runs"),
        F.max_by(_whole("n"), order).alias("last_n"), F.max_by(_whole("delta"), order).alias("last"), F.min_by(_whole("delta"), order).alias("first"),
    )
    size = sizes.groupBy("file").agg(F.sum(_whole("n") * _whole("size")).alias("bytes"))
    shorter = F.when((F.col("runs") == 2) & (F.col("last_n") == 1) & (F.col("last") < F.col("first")), F.col("last") - F.col("first"))
    return time.join(size, "file", "left").select("file", "samples", "duration", F.coalesce("bytes", F.lit(0)).alias("bytes"), shorter.alias("last_frame"))
