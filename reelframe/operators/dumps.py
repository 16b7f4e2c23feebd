"""Field dumps as text: a heading `== Kind ...` a stream, and lines of number, name and value with tabs between.

lines: file, number (order), line. Lines before the first heading and lines of fewer than three parts are left out; of equal names in a
stream the last one counts; `\\n` in a value is a line break. Headings are counted in blocks of lines (see blocks.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators.blocks import WIDTH, running


def read(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """file, kind, idx (number in its kind), name, text."""
    head = F.col("line").startswith("== ")
    own = lines.filter("line IS NOT NULL").select("file", "number", "line").withColumn("head", F.coalesce(head, F.lit(False)))
    counted = running(own, ["file"], "number", {"before": F.col("head").cast("long")}, width).withColumn("stream", F.col("before") + F.col("head").cast("long"))
    kinds = counted.filter("head").select("file", "stream", F.regexp_extract("line", r"^== \s*(\S*)", 1).alias("kind"))
    kinds = kinds.withColumn("idx", F.row_number().over(Window.partitionBy("file", "kind").orderBy("stream")) - 1)
    parts = F.split("line", "\t")
    fields = counted.filter(~F.col("head") & (F.size(parts) >= 3)).select("file", "stream", "number", F.get(parts, F.lit(1)).alias("name"), F.replace(F.get(parts, F.lit(2)), F.lit("\\n"), F.lit("\n")).alias("text"))
    one = fields.groupBy("file", "stream", "name").agg(F.max_by("text", "number").alias("text"))
    return one.join(kinds, ["file", "stream"]).select("file", "kind", "idx", "name", "text")
