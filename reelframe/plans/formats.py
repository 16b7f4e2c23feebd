"""Queries over the formatting functions; their DuckDB forms compute with printf and integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import formatters as f
from reelframe.sources.tables import table

_GROUP = "replace(format('{{:,}}', cast({0} AS BIGINT)), ',', ' ')"


def group_sql(x: str) -> str:
    return _GROUP.format(x)


def significant_sql(v: str, digits: int) -> str:
    width = lambda x: f"greatest(cast(floor(log10(abs({x}))) AS INTEGER) + 1, 1)"
    text = lambda x, w: f"(CASE greatest({digits} - {w}, 0) " + " ".join(f"WHEN {k} THEN printf('%.{k}f', {x})" for k in range(digits)) + " END)"
    once = text(v, width(v))
    again = f"cast({once} AS DOUBLE)"
    return f"(CASE WHEN {v} = 0 THEN '{0:.{digits - 1}f}' WHEN {width(again)} = {width(v)} THEN {once} ELSE {text(again, width(again))} END)"


def grouped_sql(text: str) -> str:
    return f"(CASE WHEN contains({text}, '.') THEN {group_sql(f'split_part({text}, $$.$$, 1)')} || '.' || split_part({text}, '.', 2) ELSE {group_sql(text)} END)"


def size_sql(n: str, digits: int | None) -> str:
    value = f"({n} / (CASE WHEN {n} < 1024 THEN 1.0 WHEN {n} < 1048576 THEN 1024.0 WHEN {n} < 1073741824 THEN 1048576.0 ELSE 1073741824.0 END)::DOUBLE)"
    unit = f"(CASE WHEN {n} <= 1 THEN 'Byte' WHEN {n} < 1024 THEN 'Bytes' WHEN {n} < 1048576 THEN 'KiB' WHEN {n} < 1073741824 THEN 'MiB' ELSE 'GiB' END)"
    number = f"cast(cast(round_even({value}, 0) AS BIGINT) AS VARCHAR)" if digits is None else significant_sql(value, digits)
    return f"{number} || ' ' || {unit}"


def q_size_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 977).alias("n"))
    return d.select("doc_id", *(f.size_string(F.col("n"), k).alias(f"s{k or 1}") for k in (None, 2, 3, 4)))


def q_duration_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("long").alias("ms"), (F.col("l_quantity").cast("long") + 10).cast("double").alias("fps"))
    return rows.select("l_orderkey", "l_linenumber", f.duration_strings(F.col("ms") * 100, F.col("fps")).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


_DURATION = """
WITH t AS (SELECT l_orderkey, l_linenumber, cast(trunc(l_extendedprice) AS BIGINT) * 100 AS ms, trunc(l_quantity)::BIGINT + 10 AS fps FROM lineitem),
u AS (SELECT *, ms // 3600000 AS h, ms // 60000 % 60 AS m, ms // 1000 % 60 AS s, ms % 1000 AS r FROM t),
v AS (SELECT *, printf('%02d:%02d:%02d', h, m, s) AS clock, [h || ' h', m || ' min', s || ' s', r || ' ms'] AS w, CASE WHEN h > 0 THEN 1 WHEN m > 0 THEN 2 WHEN s > 0 THEN 3 ELSE 4 END AS k FROM u),
x AS (SELECT *, clock || '.' || printf('%03d', r) AS s3, clock || ':' || printf('%02d', cast(floor(r * fps::DOUBLE / 1000.0) AS BIGINT)) AS s4 FROM v)
SELECT l_orderkey, l_linenumber, array_to_string(w[k:4], ' ') AS s1, array_to_string(w[k:least(k + 1, 4)], ' ') AS s2, s3, s4, s3 || ' (' || s4 || ')' AS s5 FROM x"""


def q_duration_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", f.duration_strings((F.col("c_acctbal") * 1000).cast("long")).alias("d"))
    return c.select("c_custkey", "d.s1", "d.s3", "d.s4", "d.s5")


_NEGATIVE = """
WITH t AS (SELECT c_custkey, cast(trunc(c_acctbal * 1000) AS BIGINT) AS v FROM customer),
u AS (SELECT c_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END AS sign, abs(v) AS ms FROM t),
v AS (SELECT *, ms // 3600000 AS h, ms // 60000 % 60 AS m, ms // 1000 % 60 AS s, ms % 1000 AS r FROM u)
SELECT c_custkey, sign || array_to_string([h || ' h', m || ' min', s || ' s', r || ' ms'][CASE WHEN h > 0 THEN 1 WHEN m > 0 THEN 2 WHEN s > 0 THEN 3 ELSE 4 END:4], ' ') AS s1,
 sign || printf('%02d:%02d:%02d.%03d', h, m, s, r) AS s3, '' AS s4, sign || printf('%02d:%02d:%02d.%03d', h, m, s, r) AS s5 FROM v"""


def q_bitrate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = F.floor(F.col("o_totalprice")) * F.element_at(F.array(*map(F.lit, (1, 13, 1700, 190_000))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", f.bitrate_string(v.cast("double")).alias("bitrate"))


_BITRATE = f"""
WITH t AS (SELECT o_orderkey, (floor(o_totalprice) * [1, 13, 1700, 190000][o_orderkey % 4 + 1])::DOUBLE AS v FROM orders)
SELECT o_orderkey, CASE WHEN v < 10000 THEN {group_sql("round(v)")} || ' b/s' WHEN v < 10000000 THEN {grouped_sql(significant_sql("(v / 1000.0::DOUBLE)", 3))} || ' kb/s'
 WHEN v < 10000000000 THEN {grouped_sql(significant_sql("(v / 1000000.0::DOUBLE)", 3))} || ' Mb/s' ELSE {grouped_sql(significant_sql("(v / 1000000000.0::DOUBLE)", 3))} || ' Gb/s' END AS bitrate FROM t"""


def q_sampling_rate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", f.sampling_rate_string(F.floor(F.col("p_retailprice")).cast("double") * (F.col("p_size") + 1)).alias("rate"))


_SAMPLING = f"""
WITH t AS (SELECT p_partkey, floor(p_retailprice)::DOUBLE * (p_size + 1) AS v FROM part)
SELECT p_partkey, CASE WHEN v < 10000 THEN {group_sql("round(v)")} || ' Hz' ELSE {grouped_sql(significant_sql("(v / 1000.0::DOUBLE)", 3))} || ' kHz' END AS rate FROM t"""


def q_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", f.thousands(F.col("o_orderkey") * 7919).alias("grouped"))


def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", f.pixels_string(p * 40).alias("pixels"), f.unit_string(p, "channel", "channels", True).alias("channels"), f.unit_string(p, "bit", "bits").alias("bits"), f.unit_string(p, "frame", "frames").alias("frames"))


def q_frame_rate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = (F.floor(F.col("l_extendedprice")) / F.col("l_quantity")).cast("double")
    per = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 512)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f.frame_rate_string(rate, per).alias("rate"))


_FRAME_RATE = f"""
WITH t AS (SELECT l_orderkey, l_linenumber, printf('%.3f', (floor(l_extendedprice)::DOUBLE / l_quantity::DOUBLE)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, {grouped_sql("v")} || ' FPS' || CASE WHEN l_linenumber % 2 = 0 THEN ' (' || l_linenumber * 512 || ' SPF)' ELSE '' END AS rate FROM t"""


def q_aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", f.aspect_ratio_string((F.col("p_size") + 20).cast("double") / 24.0).alias("ratio"))


_ASPECT = "WITH t AS (SELECT p_partkey, (p_size + 20)::DOUBLE / 24.0::DOUBLE AS v FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN abs(v - {x}::DOUBLE) < 0.011::DOUBLE THEN '{n}'" for x, n in f.ASPECT_NAMES) + " ELSE printf('%.3f', v) || ':1' END AS ratio FROM t"


def q_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    share = F.floor("l_extendedprice").cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", share.alias("part"))
    whole = F.sum("part").over(Window.partitionBy("l_orderkey"))
    return rows.withColumn("whole", whole).select("l_orderkey", "l_linenumber", f.proportion(F.col("part"), F.col("whole")).alias("proportion"))


_PROPORTION = """
WITH t AS (SELECT l_orderkey, l_linenumber, cast(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem), u AS (SELECT *, sum(p) OVER (PARTITION BY l_orderkey) AS w FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN w <= 0 THEN '' ELSE printf('%.5f', p::DOUBLE / w::DOUBLE) END AS proportion FROM u"""


def q_ntsc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.element_at(F.array(*(F.lit(x) for x in (23.976, 29.97, 59.94, 25.0, 47.952, 119.88))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", f.ntsc_fraction(near).cast("int").alias("numerator"))


_NTSC = "WITH t AS (SELECT p_partkey, [23.976, 29.97, 59.94, 25.0, 47.952, 119.88][p_partkey % 6 + 1]::DOUBLE AS v FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN abs(v - {n}::DOUBLE / 1001) < 0.0005::DOUBLE THEN {n}" for n in f.NTSC_NUMERATORS) + " END AS numerator FROM t"

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
ORACLE = {
    "q_size_strings": f"WITH t AS (SELECT doc_id, n_chars * 977 AS n FROM documents) SELECT doc_id, {', '.join(f'{size_sql("n", k)} AS s{k or 1}' for k in (None, 2, 3, 4))} FROM t",
    "q_duration_strings": _DURATION,
    "q_duration_negative": _NEGATIVE,
    "q_bitrate_string": _BITRATE,
    "q_sampling_rate_string": _SAMPLING,
    "q_thousands": f"SELECT o_orderkey, {group_sql('o_orderkey * 7919')} AS grouped FROM orders",
    "q_units": f"SELECT p_partkey, {group_sql('p_size * 40')} || ' pixels' AS pixels, CASE WHEN p_size = 1 THEN '1 channel' ELSE p_size || ' channels' END AS channels, CASE WHEN p_size = 1 THEN '1 bit' ELSE p_size || ' bits' END AS bits, CASE WHEN p_size = 1 THEN '1 frame' ELSE p_size || ' frames' END AS frames FROM part",
    "q_frame_rate_string": _FRAME_RATE,
    "q_aspect_ratio": _ASPECT,
    "q_proportion": _PROPORTION,
    "q_ntsc_fraction": _NTSC,
}
