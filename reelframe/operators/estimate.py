"""Totals of packets of a file's streams: exact by default, or scaled up from the part before a bound, with the error that this can make.

parts: file, stream, at (byte position), size; files: file, bytes. The estimate counts packets that begin before `bound` and scales by the file's
bytes over the scanned ones. Its error is two standard errors of a ratio estimate over blocks of `block` bytes, with the finite population's correction:
it tells how unevenly the packets lie in the scanned part, and nothing of a file whose rest is of another kind. A file that
ends before the bound has exact totals and no error; with fewer than two blocks the error is unknown (null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16


def totals(parts: DataFrame, files: DataFrame, bound: int | None = None, block: int = BLOCK) -> DataFrame:
    """file, stream, packets, bytes, exact, error (packets, two standard errors)."""
    if bound is None:
        whole = parts.groupBy("file", "stream").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").cast("long").alias("bytes"))
        return whole.select("*", F.lit(True).alias("exact"), F.lit(0.0).alias("error"))
    sizes = files.select("file", F.col("bytes").cast("long").alias("all"))
    seen = parts.filter(F.col("at") < bound).withColumn("block", F.floor(F.col("at") / block))
    blocks = seen.groupBy("file", "stream", "block").agg(F.count(F.lit(1)).alias("x"), F.sum("size").alias("y"))
    own = blocks.join(sizes, "file").withColumn("scanned", F.least("all", F.lit(bound)))
    within = F.least(F.lit(block), F.col("scanned") - F.col("block") * block).cast("double")
    one = own.withColumn("b", within).groupBy("file", "stream", "all", "scanned").agg(
        F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("x")).cast("double").alias("xx"), F.sum(F.col("x") * F.col("b")).alias("xb"), F.sum(F.col("b") * F.col("b")).alias("met"),
    )
    # Blocks without a packet of the stream have none, which the sums over all blocks take in.
    k, last = F.ceil(F.col("scanned") / block).cast("double"), F.col("scanned") - F.floor((F.col("scanned") - 1) / block) * block
    bb = (k - 1) * float(block) * block + last.cast("double") * last
    rate = F.col("x") / F.col("scanned")
    spread = F.greatest(F.col("xx") - 2 * rate * F.col("xb") + rate * rate * bb, F.lit(0.0))
    scale = F.col("all").cast("double") / F.col("scanned")
    exact = F.col("all") <= bound
    error = F.when(exact, 0.0).when(k > 1, 2 * scale * F.sqrt(k / F.nullif(k - 1, F.lit(0.0)) * spread * (1 - F.lit(1.0) / scale)))
    whole = lambda c: F.when(exact, F.col(c)).otherwise(F.round(F.col(c) * scale)).cast("long").alias(c)
    return one.select("file", "stream", whole("x").alias("packets"), whole("y").alias("bytes"), exact.alias("exact"), error.alias("error"))
