"""Queries over the per-file summaries: orders act as files, their line items as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.operators import streams as op
from reelframe.sources.tables import table

_STREAMS = """t AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'A' THEN 'Audio' WHEN 'N' THEN 'Video' ELSE 'Text' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax)::INTEGER AS idx,
 ['AVC', 'HEVC', 'AAC', 'SubRip'][l_suppkey % 4 + 1] AS format, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS hint, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE lower(l_returnflag) END AS language,
 CASE WHEN l_discount < 0.03 THEN 'VBR' WHEN l_discount < 0.09 THEN 'CBR' END AS mode, CASE WHEN l_tax < 0.07 THEN cast(trunc(l_quantity) AS BIGINT) * 1000 END AS size,
 cast(trunc(l_extendedprice) AS BIGINT)::DOUBLE AS duration, cast(trunc(l_quantity) AS BIGINT) AS rate FROM lineitem)"""


def streams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("long")
    kind = F.when(F.col("l_returnflag") == "A", "Audio").when(F.col("l_returnflag") == "N", "Video").otherwise("Text")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    formats = F.array(*map(F.lit, ("AVC", "HEVC", "AAC", "SubRip")))
    mode = F.when(F.col("l_discount") < 0.03, "VBR").when(F.col("l_discount") < 0.09, "CBR")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), kind.alias("kind"), F.row_number().over(order).alias("idx"), F.element_at(formats, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("format"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("hint"), F.when(F.col("l_linenumber") % 2 != 0, F.lower("l_returnflag")).alias("language"),
        mode.alias("mode"), F.when(F.col("l_tax") < 0.07, whole("l_quantity") * 1000).alias("size"), whole("l_extendedprice").cast("double").alias("duration"), whole("l_quantity").alias("rate"),
    )


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_totalprice").cast("long").alias("file_size"))


def q_general_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams_of(spark, sf_dir).groupBy("file").agg(*(F.count_if(F.col("kind") == k).alias(f"{k.lower()}_count") for k in ("Video", "Audio", "Text")))


def q_general_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kind_summary(streams_of(spark, sf_dir))


_LISTS = f"""WITH {_STREAMS}, u AS (SELECT *, CASE WHEN hint = '' OR format = '' THEN format ELSE format || ' (' || hint || ')' END AS hinted FROM t)
SELECT file, kind, count(*) AS count, {", ".join(f"CASE WHEN max(coalesce({c}, '')) <> '' THEN string_agg(coalesce({c}, ''), ' / ' ORDER BY idx) END AS {n}" for c, n in (("format", "format_list"), ("hinted", "hint_list"), ("language", "language_list")))} FROM u GROUP BY file, kind"""


def q_overall_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams_of(spark, sf_dir).groupBy("file").agg(op.overall_mode(F.col("mode"), F.col("kind")).alias("mode"))


_MODE = "CASE WHEN bool_or(kind IN ('Video', 'Audio') AND coalesce(mode, '') = 'VBR') THEN 'VBR' WHEN bool_or(kind IN ('Video', 'Audio')) AND bool_and(kind NOT IN ('Video', 'Audio') OR coalesce(mode, '') = 'CBR') THEN 'CBR' END"


def q_sizes_all_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams_of(spark, sf_dir).groupBy("file").agg(op.known_total(F.col("size")).alias("stream_bytes"))


def q_max_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams_of(spark, sf_dir).groupBy("file").agg(F.round(F.max("duration")).cast("long").alias("duration"))


def q_general_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.general_summary(streams_of(spark, sf_dir), files_of(spark, sf_dir))


_SUMMARY = f"""WITH {_STREAMS}, g AS (SELECT file, count(*) AS streams, cast(round(max(duration)) AS BIGINT) AS duration, {_MODE} AS mode, CASE WHEN count(*) = count(size) THEN sum(size) END AS stream_bytes, arg_min(rate, idx) FILTER (kind = 'Video') AS frame_rate FROM t GROUP BY file)
SELECT o_orderkey AS file, cast(trunc(o_totalprice) AS BIGINT) AS file_size, coalesce(streams, 0) AS streams, duration, mode, frame_rate,
 CASE WHEN duration > 0 THEN cast(round(trunc(o_totalprice)::DOUBLE * 8000.0::DOUBLE / duration) AS BIGINT) END AS bit_rate,
 CASE WHEN trunc(o_totalprice) >= stream_bytes THEN cast(trunc(o_totalprice) AS BIGINT) - stream_bytes END AS overhead FROM orders LEFT JOIN g ON file = o_orderkey"""


def q_first_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams_of(spark, sf_dir).filter("kind = 'Video'").groupBy("file").agg(F.min_by("rate", "idx").alias("frame_rate"))


def q_stream_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.numbered(streams_of(spark, sf_dir)).select("file", "kind", "idx", "kind_id", "kind_count", "kind_pos")


def q_residual_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams_of(spark, sf_dir).withColumn("residual", F.lit(100_000).cast("long"))
    return op.residual_share(rows, "rate", "residual").select("file", "idx", "share")


def q_default_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.default_in_group(streams_of(spark, sf_dir), ["file", "kind", "format"]).select("file", "idx", "is_default")


def q_set_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.last_wins(streams_of(spark, sf_dir), ["file", "kind"], "format", ["idx"])


def q_set_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_wins(streams_of(spark, sf_dir), ["file", "kind"], "hint", ["idx"])


def q_stream_size_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams no larger than their file, with the percentage and the proportion of it."""
    from reelframe.functions.formatters import proportion, size_string

    rows = streams_of(spark, sf_dir).join(files_of(spark, sf_dir), "file").filter(F.col("size") <= F.col("file_size"))
    percent = F.round(F.col("size").cast("double") / F.col("file_size") * 100.0).cast("long")
    return rows.select("file", "idx", F.concat(size_string(F.col("size")), F.lit(" ("), percent.cast("string"), F.lit("%)")).alias("text"), proportion(F.col("size"), F.col("file_size")).alias("proportion"))


def q_topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest streams of each file; ties keep the lower number."""
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.col("duration").desc(), "idx"))
    return streams_of(spark, sf_dir).withColumn("place", best).filter("place <= 3").select("file", "place", "idx")


def q_union_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams_of(spark, sf_dir).select("file", "kind", "idx", "format")
    files = files_of(spark, sf_dir).select("file", F.lit("General").alias("kind"), F.lit(0).alias("idx"), F.lit("Order").alias("format"))
    return files.unionByName(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file").alias("files"))


def q_elementary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one stream take its format."""
    return streams_of(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.any_value("format").alias("format")).filter("n = 1").select("file", "format")


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}


def _size_text() -> str:
    from reelframe.plans.formats import size_sql

    return size_sql("size", 3)


ORACLE = {
    "q_general_counts": f"WITH {_STREAMS} SELECT file, count(*) FILTER (kind = 'Video') AS video_count, count(*) FILTER (kind = 'Audio') AS audio_count, count(*) FILTER (kind = 'Text') AS text_count FROM t GROUP BY file",
    "q_general_lists": _LISTS,
    "q_overall_mode": f"WITH {_STREAMS} SELECT file, {_MODE} AS mode FROM t GROUP BY file",
    "q_sizes_all_known": f"WITH {_STREAMS} SELECT file, cast(CASE WHEN count(*) = count(size) THEN sum(size) END AS BIGINT) AS stream_bytes FROM t GROUP BY file",
    "q_max_duration": f"WITH {_STREAMS} SELECT file, cast(round(max(duration)) AS BIGINT) AS duration FROM t GROUP BY file",
    "q_general_summary": _SUMMARY.replace("THEN sum(size) END", "THEN cast(sum(size) AS BIGINT) END"),
    "q_first_video": f"WITH {_STREAMS} SELECT file, arg_min(rate, idx) AS frame_rate FROM t WHERE kind = 'Video' GROUP BY file",
    "q_stream_numbering": f"WITH {_STREAMS}, u AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY idx) AS p, count(*) OVER (PARTITION BY file, kind) AS c FROM t) SELECT file, kind, idx, cast(p - 1 AS INTEGER) AS kind_id, c AS kind_count, CASE WHEN c > 1 THEN p::INTEGER END AS kind_pos FROM u",
    "q_residual_share": f"WITH {_STREAMS} SELECT file, idx, cast(floor((100000 * rate)::DOUBLE / sum(rate) OVER (PARTITION BY file)) AS BIGINT) AS share FROM t",
    "q_default_in_group": f"WITH {_STREAMS} SELECT file, idx, row_number() OVER (PARTITION BY file, kind, format ORDER BY idx) = 1 AS is_default FROM t",
    "q_set_last_wins": f"WITH {_STREAMS} SELECT file, kind, arg_max(format, idx) AS format FROM t GROUP BY file, kind",
    "q_set_if_empty": f"WITH {_STREAMS} SELECT file, kind, arg_min(hint, idx) FILTER (coalesce(hint, '') <> '') AS hint FROM t GROUP BY file, kind",
    "q_stream_size_percent": f"WITH {_STREAMS}, u AS (SELECT t.*, cast(trunc(o_totalprice) AS BIGINT) AS fs FROM t JOIN orders ON o_orderkey = file) SELECT file, idx, {_size_text()} || ' (' || cast(round(size::DOUBLE / fs * 100.0::DOUBLE) AS BIGINT) || '%)' AS text, printf('%.5f', size::DOUBLE / fs) AS proportion FROM u WHERE size <= fs",
    "q_topk_candidates": f"WITH {_STREAMS}, u AS (SELECT file, idx, row_number() OVER (PARTITION BY file ORDER BY duration DESC, idx)::INTEGER AS place FROM t) SELECT file, place, idx FROM u WHERE place <= 3",
    "q_union_kinds": f"WITH {_STREAMS}, u AS (SELECT file, kind FROM t UNION ALL SELECT o_orderkey, 'General' FROM orders) SELECT kind, count(*) AS rows, count(DISTINCT file) AS files FROM u GROUP BY kind",
    "q_elementary_stream": f"WITH {_STREAMS} SELECT file, any_value(format) AS format FROM t GROUP BY file HAVING count(*) = 1",
}
