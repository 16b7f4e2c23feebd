"""Per-file summaries of stream rows: counts, ordered lists, modes, totals, and positions.

Stream rows have file, kind (General, Video, Audio, Text, Other, Image, Menu), idx, and fields. Every summary is a
grouped aggregate with partial sums; ordered lists sort what they gathered by idx, so they don't depend on task order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds by number.
KINDS = ["General", "Video", "Audio", "Text", "Other", "Image", "Menu"]


def ordered_list(value: str, order: str, separator: str = " / ") -> Column:
    """Values joined in order, one entry per row (empty where unknown); null when all are empty."""
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(value), F.lit("")).alias("v"))))
    return F.when(F.max(F.coalesce(F.col(value), F.lit(""))) != "", F.array_join(F.transform(texts, lambda x: x["v"]), separator))


def kind_summary(streams: DataFrame) -> DataFrame:
    """file, kind: count, and the lists of formats, formats with hints, and languages."""
    hinted = F.when((F.coalesce("hint", F.lit("")) == "") | (F.coalesce("format", F.lit("")) == ""), F.col("format")).otherwise(F.concat("format", F.lit(" ("), "hint", F.lit(")")))
    rows = streams.withColumn("hinted", hinted)
    return rows.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("count"), ordered_list("format", "idx").alias("format_list"), ordered_list("hinted", "idx").alias("hint_list"), ordered_list("language", "idx").alias("language_list"))


def overall_mode(mode: Column, kind: Column) -> Column:
    """VBR if any video or audio stream is, CBR if all are, else null."""
    counted = kind.isin("Video", "Audio")
    known = F.coalesce(mode, F.lit(""))
    return F.when(F.bool_or(counted & (known == "VBR")), "VBR").when(F.bool_or(counted) & F.bool_and(~counted | (known == "CBR")), "CBR")


def known_total(size: Column) -> Column:
    """The sum if every row has a size."""
    return F.when(F.count(F.lit(1)) == F.count(size), F.sum(size))


def general_summary(streams: DataFrame, files: DataFrame) -> DataFrame:
    """A row per file: duration, bit rate, mode, first video's rate, what is left beside the streams."""
    totals = streams.groupBy("file").agg(
        F.count(F.lit(1)).alias("streams"), F.round(F.max("duration")).cast("long").alias("duration"), overall_mode(F.col("mode"), F.col("kind")).alias("mode"),
        known_total(F.col("size")).alias("stream_bytes"), F.min_by("rate", F.when(F.col("kind") == "Video", F.col("idx"))).alias("frame_rate"),
    )
    rate = F.when(F.col("duration") > 0, F.round(F.col("file_size").cast("double") * 8000.0 / F.col("duration")).cast("long"))
    return files.join(totals, "file", "left").select("file", "file_size", F.coalesce("streams", F.lit(0)).alias("streams"), "duration", "mode", "frame_rate", rate.alias("bit_rate"), F.when(F.col("file_size") >= F.col("stream_bytes"), F.col("file_size") - F.col("stream_bytes")).alias("overhead"))


def numbered(streams: DataFrame) -> DataFrame:
    """Number of each stream within its kind, from 0, the kind's count, and its place where there are several."""
    own = Window.partitionBy("file", "kind")
    place = F.row_number().over(own.orderBy("idx"))
    count = F.count(F.lit(1)).over(own)
    return streams.withColumns({"kind_id": (place - 1).cast("int"), "kind_count": count, "kind_pos": F.when(count > 1, place)})


def residual_share(streams: DataFrame, payload: str, residual: str) -> DataFrame:
    """A file's residual bytes dealt to its streams by payload."""
    total = F.sum(payload).over(Window.partitionBy("file"))
    return streams.withColumn("share", F.when(total > 0, F.floor(F.col(residual) * F.col(payload) / total)).otherwise(0).cast("long"))


def default_in_group(streams: DataFrame, group: list[str]) -> DataFrame:
    """Whether a stream is the first of its alternate group."""
    return streams.withColumn("is_default", F.row_number().over(Window.partitionBy(*group).orderBy("idx")) == 1)


def last_wins(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_wins(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The first non-empty value."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(F.coalesce(value, F.lit("")) != "", F.struct(*order))).alias(value))
