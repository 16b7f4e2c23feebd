"""Queries over sample runs, clocks and assignments: a conversation acts as a file, its turns as runs, stamps, windows and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators import assign, clocks, demux, runs
from reelframe.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, turn, role and l, the characters of the text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), "turn", "role", F.length("text").cast("long").alias("l"))


_T = "t AS (SELECT conv_id::VARCHAR AS file, turn, role, length(text)::BIGINT AS l FROM conversations)"


def sample_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Windows, runs of times, runs of sizes and timescales."""
    rows = _turns(spark, sf_dir)
    n, l = F.col("turn"), F.col("l")  # noqa: E741
    windows = rows.filter("l IS NOT NULL").select("file", n.alias("window"), (l % 97 * 10).alias("start"), (l % 1009).alias("length"))
    times = rows.select("file", n.alias("run"), (l % 40).alias("n"), (l % 7 * 10).alias("delta"))
    sizes = rows.filter(n % 5 < 4).select("file", n.alias("run"), (l % 31 + 1).alias("n"), (l % 1000).alias("size"))
    scales = rows.groupBy("file").agg((F.min("turn") + F.lit(1000)).alias("timescale"))
    return windows, times, sizes, scales


def q_edit_window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and bytes inside each edit window, from runs in closed form."""
    return runs.within(*sample_tables(spark, sf_dir))


def q_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, times, sizes, _ = sample_tables(spark, sf_dir)
    return runs.totals(times, sizes)


def stamps(spark: SparkSession, sf_dir: str, period: int) -> DataFrame:
    """A clock that wraps every third turn or so, repeats a stamp at times, and falls back a little at others."""
    n, l = F.col("turn"), F.col("l")  # noqa: E741
    ticks = F.when(n % 6 == 5, (n - 1) * F.lit(period // 3 + 77)).otherwise(n * F.lit(period // 3 + 77)) + F.when(l % 8 == 0, F.lit(-900)).otherwise(F.lit(0))
    return _turns(spark, sf_dir).select("file", n.alias("number"), F.when(l % 11 != 10, F.pmod(ticks, F.lit(period))).alias("clock"), (n * 188_000 + l).alias("at"))


def q_clock_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.unwrapped(stamps(spark, sf_dir, 1 << 33)).select("file", "number", "clock", "wraps", "time")


def q_clock_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.rates(stamps(spark, sf_dir, (1 << 33) * 300))


def q_clock_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.spans(stamps(spark, sf_dir, (1 << 33) * 300))


def streams_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Streams and a codec list of each file, in which keys repeat, miss and fit, and either side may be longer."""
    rows = _turns(spark, sf_dir)
    n, l = F.col("turn"), F.col("l")  # noqa: E741
    kind = F.when(F.col("role") == "user", "Video").otherwise("Audio")
    key = lambda x: F.element_at(F.array(*map(F.lit, ("WMV3", "55", "", "WMV3", "161"))), (x % 5 + 1).cast("int"))
    streams = rows.filter("l IS NOT NULL").select("file", kind.alias("kind"), key(l).alias("key"), n.alias("number"))
    entries = rows.filter(l % 3 > 0).select("file", F.when(l % 13 == 0, "Text").otherwise(kind).alias("kind"), key(l + n % 2).alias("key"), n.alias("number"), F.concat(F.lit("codec "), l.cast("string")).alias("description"))
    return streams, entries


def q_codec_keyed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.keyed_first(*streams_and_entries(spark, sf_dir), "description")


def q_codec_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.in_order(*streams_and_entries(spark, sf_dir), "description")


def q_packet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as packets of two pids, some sent twice, some lost: units with their gaps, whether they are closed, and a digest."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    n, l = F.col("turn"), F.length("text")  # noqa: E741
    twice = F.when(l % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    counter = (F.floor(n / 2) + F.when(l % 13 == 0, F.lit(2)).otherwise(F.lit(0))) % 16
    sent = rows.select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("pid"), n.alias("turn"), counter.alias("counter"), (l % 3 == 0).alias("start"), F.col("text").alias("payload"), F.explode(twice).alias("again"))
    return demux.units(sent.withColumn("number", F.col("turn") * 2 + F.col("again"))).withColumn("digest", F.md5("data")).drop("data")


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
_SAMPLES = f"""WITH {_T},
x AS (SELECT file, turn, coalesce(l % 7 * 10, 0) AS delta, unnest(range(coalesce(l % 40, 0))) AS k FROM t),
s AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY turn, k) - 1 AS sample, sum(delta) OVER (PARTITION BY file ORDER BY turn, k) - delta AS at FROM x),
y AS (SELECT file, turn, coalesce(l % 1000, 0) AS size, unnest(range(coalesce(l % 31 + 1, 0))) AS k FROM t WHERE turn % 5 < 4),
z AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY turn, k) - 1 AS sample, size FROM y),
c AS (SELECT file, min(turn) + 1000 AS scale FROM t GROUP BY file),
w AS (SELECT file, turn AS "window", l % 97 * 10 AS start, l % 1009 AS length FROM t WHERE l IS NOT NULL)
SELECT w.file, w."window", count(s.sample) AS samples, coalesce(sum(z.size), 0)::BIGINT AS bytes FROM w JOIN c USING (file)
LEFT JOIN s ON s.file = w.file AND s.at::DOUBLE / scale * 1000 >= start - 0.001::DOUBLE AND s.at::DOUBLE / scale * 1000 < start + length - 0.001::DOUBLE LEFT JOIN z ON z.file = s.file AND z.sample = s.sample GROUP BY ALL"""


def _clock(period: int) -> str:
    """Wraps counted one by one along each file's stamps."""
    step = period // 3 + 77
    ticks = f"(CASE WHEN turn % 6 = 5 THEN (turn - 1) * {step} ELSE turn * {step} END + CASE WHEN l % 8 = 0 THEN -900 ELSE 0 END)"
    return f"""WITH RECURSIVE {_T}, c AS (SELECT *, lag(clock) OVER (PARTITION BY file ORDER BY number) AS before FROM (SELECT file, turn AS number, CASE WHEN l % 11 <> 10 THEN (({ticks} % {period}) + {period}) % {period} END AS clock, turn * 188000 + l AS place FROM t) WHERE clock IS NOT NULL),
u AS (SELECT *, sum(CASE WHEN before - clock > {period // 2} THEN 1 WHEN clock - before > {period // 2} THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY number)::BIGINT AS wraps FROM c),
v AS (SELECT *, (clock + wraps * {period})::BIGINT AS time FROM u)"""


_SYSTEM = _clock((1 << 33) * 300)
_LISTS = f"""{_T}, k AS (SELECT *, CASE role WHEN 'user' THEN 'Video' ELSE 'Audio' END AS kind, ['WMV3', '55', '', 'WMV3', '161'][l % 5 + 1] AS key, ['WMV3', '55', '', 'WMV3', '161'][(l + turn % 2) % 5 + 1] AS entry_key FROM t WHERE l IS NOT NULL),
s AS (SELECT file, kind, key, turn AS number FROM k),
e AS (SELECT file, CASE WHEN l % 13 = 0 THEN 'Text' ELSE kind END AS kind, entry_key AS key, turn AS number, 'codec ' || l AS description FROM k WHERE l % 3 > 0)"""
_UNITS = """WITH p AS (SELECT conv_id::VARCHAR AS file, role AS pid, turn * 2 + again AS number, (turn // 2 + CASE WHEN length(text) % 13 = 0 THEN 2 ELSE 0 END) % 16 AS counter, length(text) % 3 = 0 AS start, text
 FROM conversations, (VALUES (0), (1)) AS v(again) WHERE text IS NOT NULL AND (again = 0 OR length(text) % 7 = 0)),
q AS (SELECT *, lag(counter) OVER o AS c, lag(text) OVER o AS t FROM p WINDOW o AS (PARTITION BY file, pid ORDER BY number)),
k AS (SELECT *, CASE WHEN c IS NOT NULL AND counter <> (c + 1) % 16 THEN 1 ELSE 0 END AS gap FROM q WHERE NOT (c IS NOT DISTINCT FROM counter AND t IS NOT DISTINCT FROM text)),
u AS (SELECT *, sum(start::INT) OVER (PARTITION BY file, pid ORDER BY number) AS unit, sum(start::INT) OVER (PARTITION BY file, pid) AS last FROM k)
SELECT file, pid, unit::BIGINT AS unit, min(number) AS first, count(*) AS packets, sum(gap)::BIGINT AS gaps, unit < any_value(last) AS closed, md5(string_agg(text, '' ORDER BY number)) AS digest FROM u WHERE unit > 0 GROUP BY file, pid, unit"""
ORACLE = {
    "q_packet_units": _UNITS,
    "q_edit_window_samples": _SAMPLES,
    "q_run_totals": f"""WITH {_T}, a AS (SELECT file, turn, coalesce(l % 40, 0) AS n, coalesce(l % 7 * 10, 0) AS delta FROM t), b AS (SELECT file, sum((l % 31 + 1) * (l % 1000))::BIGINT AS bytes FROM t WHERE turn % 5 < 4 GROUP BY file),
g AS (SELECT file, sum(n)::BIGINT AS samples, sum(n * delta)::BIGINT AS duration, count(*) AS k, arg_max(n, turn) AS z, arg_max(delta, turn) AS last, arg_min(delta, turn) AS first FROM a GROUP BY file)
SELECT file, samples, duration, coalesce(bytes, 0) AS bytes, CASE WHEN k = 2 AND z = 1 AND last < first THEN last - first END AS last_frame FROM g LEFT JOIN b USING (file)""",
    "q_clock_unwrap": f"{_clock(1 << 33)} SELECT file, number, clock, wraps, time FROM v",
    "q_clock_rates": f"""{_SYSTEM}, p AS (SELECT file, number, time, place, lag(time) OVER o AS bt, lag(place) OVER o AS ba FROM v WINDOW o AS (PARTITION BY file ORDER BY number))
SELECT file, number, (time - bt)::DOUBLE * 1000 / 27000000 AS ms, place - ba AS bytes, CASE WHEN time > bt AND place > ba THEN round((place - ba)::DOUBLE * 8000 / ((time - bt)::DOUBLE * 1000 / 27000000))::BIGINT END AS bit_rate FROM p WHERE bt IS NOT NULL""",
    "q_clock_spans": f"""{_SYSTEM}, p AS (SELECT *, lag(time) OVER (PARTITION BY file ORDER BY number) AS bt FROM v),
g AS (SELECT file, arg_min(time, number) AS a, arg_max(time, number) AS z, arg_min(place, number) AS pa, arg_max(place, number) AS pz, max(wraps) AS wraps, count(*) FILTER (time = bt) AS repeated FROM p GROUP BY file)
SELECT file, a::DOUBLE * 1000 / 27000000 AS delay, CASE WHEN z > a AND pz > pa THEN (z - a)::DOUBLE * 1000 / 27000000 END AS duration, CASE WHEN z > a AND pz > pa THEN pz - pa END AS bytes,
 CASE WHEN z > a AND pz > pa THEN round((pz - pa)::DOUBLE * 8000 / ((z - a)::DOUBLE * 1000 / 27000000))::BIGINT END AS bit_rate, wraps, repeated FROM g""",
    "q_codec_keyed_first": f"""WITH {_LISTS},
ms AS (SELECT *, row_number() OVER (PARTITION BY file, kind, key ORDER BY number) AS r FROM s), es AS (SELECT *, row_number() OVER (PARTITION BY file, kind, key ORDER BY number) AS r FROM e),
f AS (SELECT ms.file, ms.kind, ms.number, es.number AS entry, es.description FROM ms JOIN es ON es.file = ms.file AND es.kind = ms.kind AND es.key = ms.key AND es.r = ms.r WHERE ms.key <> ''),
a AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY number) AS r FROM s ANTI JOIN f USING (file, kind, number)),
b AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY number) AS r FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file = e.file AND f.kind = e.kind AND f.entry = e.number))
SELECT file, kind, number, description, true AS keyed FROM f UNION ALL SELECT a.file, a.kind, a.number, b.description, false FROM a LEFT JOIN b ON b.file = a.file AND b.kind = a.kind AND b.r = a.r""",
    "q_codec_in_order": f"""WITH RECURSIVE {_LISTS}, n AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY number) AS r FROM s),
l AS (SELECT file, kind, list({{'n': number, 'k': key, 'd': description}} ORDER BY number) AS entries FROM e GROUP BY file, kind),
w AS (SELECT n.file, n.kind, n.number, n.r, coalesce(list_filter(entries, lambda x: x.k = n.key AND x.k <> '')[1], entries[1]) AS one, len(list_filter(entries, lambda x: x.k = n.key AND x.k <> '')) > 0 AS keyed, entries AS free FROM n LEFT JOIN l USING (file, kind) WHERE r = 1
 UNION ALL SELECT n.file, n.kind, n.number, n.r, coalesce(list_filter(f, lambda x: x.k = n.key AND x.k <> '')[1], f[1]), len(list_filter(f, lambda x: x.k = n.key AND x.k <> '')) > 0, f
 FROM (SELECT *, list_filter(free, lambda x: x.n IS DISTINCT FROM one.n) AS f FROM w) AS w JOIN n ON n.file = w.file AND n.kind = w.kind AND n.r = w.r + 1)
SELECT file, kind, number, one.d AS description, coalesce(keyed, false) AS keyed FROM w""",
}
