"""Queries over duration tags, compression, dumps as text and totals: turns of conversations act as tags, lines and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions.formatters import compression_ratio
from reelframe.functions.text import hms_to_ms
from reelframe.operators import dumps, estimate
from reelframe.sources.tables import table


def q_duration_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    l = F.length("text")  # noqa: E741
    tag = F.when(l % 9 == 0, F.concat(F.lit("x:"), l.cast("string"))).otherwise(F.concat_ws(":", (l % 30).cast("string"), (l % 60).cast("string"), F.concat((l % 50).cast("string"), F.lit(".125000000"))))
    return rows.select("conv_id", "turn", hms_to_ms(tag).alias("ms"), compression_ratio(F.lit(48000), F.lit(16), l % 6, F.nullif(l * 1000, F.lit(0))).alias("ratio"))


def q_dump_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a line of its conversation's dump: a heading, a field, or something else."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    l = F.length("text")  # noqa: E741
    line = F.when(l % 4 == 0, F.concat(F.lit("== "), F.initcap("role"), F.lit(" #"), F.col("turn").cast("string"))).when(l % 4 == 1, F.concat(F.lit("no field "), l.cast("string"))).otherwise(F.concat_ws("\t", F.col("turn").cast("string"), F.concat(F.lit("Name"), (l % 2).cast("string")), F.replace("text", F.lit("\n"), F.lit("\\n"))))
    return dumps.read(rows.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("number"), line.alias("line"))).withColumn("text", F.md5("text"))


def q_packet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact totals of each stream's packets, the default."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    parts = rows.select(F.col("conv_id").alias("file"), F.col("role").alias("stream"), (F.col("turn") * 1000).alias("at"), F.length("text").cast("long").alias("size"))
    return estimate.totals(parts, parts.groupBy("file").agg(F.sum("size").alias("bytes"))).drop("error")


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
ORACLE = {
    "q_duration_tags": """SELECT conv_id, turn, CASE WHEN l % 9 <> 0 THEN ((l % 30)::DOUBLE * 60 + l % 60) * 60000::DOUBLE + (l % 50 + 0.125::DOUBLE) * 1000 END AS ms, CASE WHEN l > 0 THEN printf('%.3f', 48000 * 16 * (l % 6) / (l * 1000)::DOUBLE) END AS ratio FROM (SELECT *, length(text)::BIGINT AS l FROM conversations)""",
    "q_dump_fields": """WITH t AS (SELECT conv_id::VARCHAR AS file, turn, role, text, length(text) AS l FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, count(*) FILTER (l % 4 = 0) OVER (PARTITION BY file ORDER BY turn) AS stream FROM t),
k AS (SELECT file, stream, upper(role[1]) || role[2:] AS kind, row_number() OVER (PARTITION BY file, role ORDER BY stream)::INTEGER - 1 AS idx FROM c WHERE l % 4 = 0),
f AS (SELECT file, stream, 'Name' || l % 2 AS name, arg_max(text, turn) AS text FROM c WHERE l % 4 > 1 GROUP BY ALL) SELECT file, kind, idx, name, md5(replace(split_part(text, chr(9), 1), '\\n', chr(10))) AS text FROM f JOIN k USING (file, stream)""",
    "q_packet_totals": "SELECT conv_id AS file, role AS stream, count(*) AS packets, sum(length(text))::BIGINT AS bytes, true AS exact FROM conversations WHERE text IS NOT NULL GROUP BY ALL",
}
