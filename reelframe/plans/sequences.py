"""Queries over ordered samples: events act as samples of user streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators import sequences as op
from reelframe.sources.tables import table

_E = "e AS (SELECT event_id, user_id, cast(epoch_us(ts) AS BIGINT) // 1000 AS ms, event_type, cast(trunc(value) AS BIGINT) AS v FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", ((us - us % 1000) / 1000).cast("long").alias("ms"), "event_type", F.col("value").cast("long").alias("v"))


def q_frame_rate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.median_rate(samples(spark, sf_dir), "user_id", "ms", ["event_id"]).select("user_id", "median", "regular")


_MEDIAN = f"""WITH {_E}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e), g AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS d FROM f WHERE n <= 64),
h AS (SELECT user_id, list_sort(list(d)) AS s FROM g WHERE d > 0 GROUP BY user_id), k AS (SELECT user_id, s, s[len(s) // 2 + 1] AS median FROM h)
SELECT user_id, median, len(list_filter(s, lambda x: abs(x - median) * 20 <= median)) * 5 >= len(s) * 4 AS regular FROM k"""


def q_cfr_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = samples(spark, sf_dir).withColumn("ms", F.when(F.col("user_id") % 2 == 0, F.row_number().over(op.Window.partitionBy("user_id").orderBy("event_id")) * 40).otherwise(F.col("ms")))
    return op.constant_rate(even, "user_id", "ms", ["event_id"])


_CFR = f"""WITH {_E}, f AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 40 ELSE ms END AS ms FROM e),
g AS (SELECT user_id, event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM f), h AS (SELECT user_id, abs(d - first_value(d) OVER (PARTITION BY user_id ORDER BY event_id)) <= 1 AS near FROM g WHERE d IS NOT NULL)
SELECT user_id, bool_and(near) AS constant, count(*) AS steps FROM h GROUP BY user_id"""


def q_sample_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sample_times(samples(spark, sf_dir), "user_id", "v", ["event_id"]).select("event_id", F.col("start").cast("long").alias("start"))


def q_chunk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per chunk: the last run at or before each chunk."""
    rows = samples(spark, sf_dir)
    runs = rows.filter("event_id % 7 = 0").select("user_id", F.col("event_id").alias("first"), "v")
    return op.as_of(rows.filter("event_id % 7 <> 0"), runs, "user_id", "event_id", "first", "v")


def q_edit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = samples(spark, sf_dir).select("user_id", F.col("v").alias("duration"), F.when(F.col("event_id") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("event_id")).alias("media_time"))
    return op.edit_list(edits, "user_id")


def q_dialnorm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.loudness(samples(spark, sf_dir).withColumn("level", -(F.col("v") % 31)), "user_id", "level", ["event_id"])


_FOLD = f"""WITH {_E}, l AS (SELECT user_id, list(-(v % 31) ORDER BY event_id) AS s, min(-(v % 31)) AS least, max(-(v % 31)) AS most, count(*) AS n FROM e GROUP BY user_id)
SELECT user_id, list_reduce(list_prepend({{'m': 0::BIGINT, 'n': 0::BIGINT}}, list_transform(s, lambda x: {{'m': x, 'n': 1::BIGINT}})), lambda a, b: {{'m': cast(round((a.m * a.n + b.m)::DOUBLE / (a.n + 1)) AS BIGINT), 'n': a.n + 1}}).m AS mean, least, most, n FROM l"""


def q_gop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 12 == 0, "I").when(F.col("event_id") % 3 == 0, "P").otherwise("B")
    rows = samples(spark, sf_dir).select("user_id", F.struct("event_id", kind.alias("k")).alias("x")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["k"]), "").alias("types"))
    return rows.select("user_id", op.gop("types").alias("gop"))


_GOP = """WITH t AS (SELECT user_id, string_agg(CASE WHEN event_id % 12 = 0 THEN 'I' WHEN event_id % 3 = 0 THEN 'P' ELSE 'B' END, '' ORDER BY event_id) AS s FROM events GROUP BY user_id),
u AS (SELECT user_id, strpos(s, 'I') AS f, substr(s, strpos(s, 'I') + 1) AS a FROM t)
SELECT user_id, CASE WHEN f > 0 AND strpos(a, 'I') > 0 THEN 'M=' || CASE WHEN strpos(a, 'P') > 0 THEN least(strpos(a, 'P'), strpos(a, 'I')) ELSE strpos(a, 'I') END || ', N=' || strpos(a, 'I') END AS gop FROM u"""


def q_packet_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("start", F.col("role") == "user")
    return op.packets(rows, "conv_id", "start", ["turn"], "text").select("conv_id", F.col("packet").cast("int").alias("packet"), "parts", F.md5("data").alias("digest"))


_PACKETS = """WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::INTEGER AS packet FROM conversations)
SELECT conv_id, packet, count(*) AS parts, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM t WHERE packet > 0 GROUP BY conv_id, packet"""


def q_fragment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, least, most and first of each stream's samples."""
    return samples(spark, sf_dir).groupBy("user_id").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.min_by("v", "event_id").alias("first"), F.max_by("v", "event_id").alias("last"))


def q_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks before the first click, and clicks per other chunk."""
    rows = samples(spark, sf_dir)
    first = rows.filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("first"))
    counted = rows.join(first, "user_id").groupBy("user_id").agg(F.count_if(F.col("event_id") < F.col("first")).alias("before"), F.count_if(F.col("event_type") == "click").alias("video"), F.count_if(F.col("event_type") != "click").alias("audio"))
    return counted.select("user_id", "before", F.when(F.col("audio") > 0, F.round(F.col("video") * 100 / F.col("audio")).cast("long")).alias("ratio"))


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
ORACLE = {
    "q_frame_rate_median": _MEDIAN,
    "q_cfr_test": _CFR,
    "q_sample_window": f"WITH {_E} SELECT event_id, cast(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e",
    "q_chunk_asof": f"WITH {_E}, r AS (SELECT user_id, event_id AS f, v FROM e WHERE event_id % 7 = 0), c AS (SELECT user_id, event_id FROM e WHERE event_id % 7 <> 0) SELECT c.user_id, c.event_id, r.v FROM c ASOF LEFT JOIN r ON c.user_id = r.user_id AND c.event_id >= r.f",
    "q_edit_list": f"WITH {_E}, t AS (SELECT user_id, v AS d, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END AS m FROM e) SELECT user_id, cast(sum(CASE WHEN m = -1 THEN d ELSE 0 END) AS BIGINT) AS delay, cast(sum(CASE WHEN m <> -1 THEN d ELSE 0 END) AS BIGINT) AS presentation, min(m) FILTER (m <> -1) AS media_start FROM t GROUP BY user_id",
    "q_dialnorm_fold": _FOLD,
    "q_gop": _GOP,
    "q_packet_reassembly": _PACKETS,
    "q_fragment_totals": f"WITH {_E} SELECT user_id, cast(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, arg_min(v, event_id) AS first, arg_max(v, event_id) AS last FROM e GROUP BY user_id",
    "q_interleave": f"WITH {_E}, f AS (SELECT user_id, min(event_id) AS f FROM e WHERE event_type = 'click' GROUP BY user_id), g AS (SELECT user_id, count(*) FILTER (event_id < f) AS before, count(*) FILTER (event_type = 'click') AS v, count(*) FILTER (event_type <> 'click') AS a FROM e JOIN f USING (user_id) GROUP BY user_id) SELECT user_id, before, CASE WHEN a > 0 THEN cast(round((v * 100)::DOUBLE / a) AS BIGINT) END AS ratio FROM g",
}
