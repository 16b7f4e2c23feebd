"""Queries over tracks: events act as packets, samples and chapters, users as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators import sequences as op
from reelframe.sources.tables import table


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("long")
    kind = F.element_at(F.array(F.lit("Video"), F.lit("Audio"), F.lit("Text")), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), n.alias("seq"), (n * 7919 % 100).alias("time"), (n * 31 % 50 + 1).alias("size"), kind.alias("kind"), (n % 5).alias("chunk"))


def q_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_and_last(_packets(spark, sf_dir), "file", "time", "size", ["seq"])


def q_sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sample_offsets(_packets(spark, sf_dir).withColumn("start", F.col("chunk") * 1000), ["file", "chunk"], "size", ["seq"], "start").select("seq", "offset")


def q_rate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rate_range(_packets(spark, sf_dir), "file", "size", ["seq"])


def q_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_totals(_packets(spark, sf_dir), ["file", "kind"], "size", 4)


def q_video_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.video_delay(_packets(spark, sf_dir), "file", "kind", "time", "seq").select("seq", "video_delay")


def q_stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("kind") == "Video", 0).when(F.col("kind") == "Audio", 1).otherwise(2)
    return op.stream_order(_packets(spark, sf_dir), "file", rank, "time", "seq").select("seq", "place")


def q_program_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.menus(_packets(spark, sf_dir), ["file", "chunk"], "kind", ["seq"])


def q_chapter_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chapter_positions(_packets(spark, sf_dir), "file", "time", 94, "seq").select("seq", "pos")


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
_P = "WITH p AS (SELECT user_id AS file, event_id::BIGINT AS seq, event_id * 7919 % 100 AS time, event_id * 31 % 50 + 1 AS size, ['Video', 'Audio', 'Text'][event_id % 3 + 1] AS kind, event_id % 5 AS chunk FROM events)"
ORACLE = {
    "q_first_last": f"{_P}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS a, row_number() OVER (PARTITION BY file ORDER BY time DESC, seq DESC) AS z FROM p) SELECT file, max(time) FILTER (a = 1) AS first, max(time + size) FILTER (z = 1) AS last FROM n GROUP BY file",
    "q_sample_offsets": f"{_P} SELECT seq, (chunk * 1000 + coalesce(sum(size) OVER (PARTITION BY file, chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset FROM p",
    "q_rate_range": f"{_P}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq DESC) AS z FROM p) SELECT file, 1000.0::DOUBLE / max(size) AS rate_min, 1000.0::DOUBLE / min(size) AS rate_max, coalesce(max(size) FILTER (z = 1) < min(size) FILTER (z > 1), false) AS last_shorter FROM n GROUP BY file",
    "q_index_totals": f"{_P} SELECT file, kind, count(*) AS chunks, (sum(size) * 4)::BIGINT AS bytes FROM p GROUP BY file, kind",
    "q_video_delay": f"{_P}, v AS (SELECT file, arg_min(time, seq) AS t FROM p WHERE kind = 'Video' GROUP BY file) SELECT seq, CASE WHEN kind = 'Audio' THEN time - t END AS video_delay FROM p LEFT JOIN v USING (file)",
    "q_stream_order": f"{_P} SELECT seq, row_number() OVER (PARTITION BY file ORDER BY CASE kind WHEN 'Video' THEN 0 WHEN 'Audio' THEN 1 ELSE 2 END, time, seq)::INTEGER - 1 AS place FROM p",
    "q_program_menus": f"{_P} SELECT file, chunk, string_agg(kind, ' / ' ORDER BY seq) AS list FROM p GROUP BY file, chunk",
    "q_chapter_positions": f"{_P} SELECT seq, row_number() OVER (PARTITION BY file ORDER BY time, seq)::INTEGER + 93 AS pos FROM p",
}
