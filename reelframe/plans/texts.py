"""Queries over languages, names, text cleaning, escapes and time strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import text as f
from reelframe.sources.tables import table

_CODES = "VALUES " + ", ".join(f"('{a}', '{t}', '{b}', '{n}')" for a, t, b, n in f.LANGUAGES)
_LANGUAGES = f"l AS (SELECT DISTINCT unnest([a, t, b]) AS code, a, t, n FROM ({_CODES}) AS v(a, t, b, n))"
_TAGGED = f"WITH {_LANGUAGES}, d AS (SELECT doc_id, lang || ['', '-us', '_BR', '-Latn'][doc_id % 4 + 1] AS tag FROM documents UNION ALL SELECT doc_id + 1000000, ['ger', 'xx-yy', 'FRA', 'q'][doc_id % 4 + 1] FROM documents), u AS (SELECT *, lower(regexp_extract(tag, '^([^-_]*)', 1)) AS base, upper(regexp_extract(tag, '^[^-_]*[-_](.*)$', 1)) AS region FROM d), v AS (SELECT u.*, code, a, t, n, CASE WHEN region <> '' THEN '-' || region ELSE '' END AS tail FROM u LEFT JOIN l ON base = code)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    odd = F.element_at(F.array(*map(F.lit, ("ger", "xx-yy", "FRA", "q"))), (F.col("doc_id") % 4 + 1).cast("int"))
    region = F.element_at(F.array(*map(F.lit, ("", "-us", "_BR", "-Latn"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", F.concat("lang", region).alias("tag")).unionByName(d.select((F.col("doc_id") + 1_000_000).alias("doc_id"), odd.alias("tag")))


def q_language_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.with_language(_tags(spark, sf_dir), "tag").select("doc_id", "normal")


def q_language_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.with_language(_tags(spark, sf_dir), "tag").select("doc_id", "full", "two_letters", "three_letters", "either")


def q_html_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1).alias("tag"))
    return f.with_language(pages, "tag").select("page_id", "tag", "full")


def q_datetime_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", f.utc_text(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("text"))


def q_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of three other epochs and back to dates."""
    unix = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    mac, mkv, ticks = unix + f.MAC_EPOCH, (unix - f.MATROSKA_EPOCH) * 1_000_000_000, (unix + f.FILETIME_EPOCH) * 10_000_000
    whole = lambda x, by: ((x - x % by) / by).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", mac.alias("mac"), ticks.alias("ticks"), f.utc_text(mac - f.MAC_EPOCH).alias("from_mac"), f.utc_text(F.expr("0") + whole(mkv, 1_000_000_000) + f.MATROSKA_EPOCH).alias("from_mkv"), f.utc_text(whole(ticks, 10_000_000) - f.FILETIME_EPOCH).alias("from_ticks"))


def q_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", f.extension(path).alias("extension"))


def q_file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", f.file_parts(F.regexp_replace("url", r"\?.*$", "")).alias("p")).select("page_id", "p.*")


def q_extension_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.element_at(F.array(F.lit("html htm xhtml"), F.lit("com org"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, ("HTML", "net", "com"))), (F.col("page_id") % 3 + 1).cast("int")).alias("ext"), known.alias("known"))
    return rows.select("page_id", ((F.col("known") != "") & ~F.array_contains(F.split("known", " "), F.lower("ext"))).alias("invalid"))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(" \t"), F.substring("text", 1, 100), F.lit("\x01\x1f\n \r"))
    return table(spark, sf_dir, "documents").select("doc_id", f.clean_text(dirty).alias("text"))


def q_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bytes are UTF-8 text without control characters, and their number."""
    raw = F.to_binary("text", F.lit("utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(raw).cast("long").alias("n_bytes"), (F.is_valid_utf8("text") & ~F.col("text").rlike(r"[\x00-\x08\x0E-\x1F]")).alias("is_text"))


def q_xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(f.xml_escape(F.col("html"))).alias("digest"), F.length(f.xml_escape(F.col("html"))).cast("long").alias("size"))


def q_json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(f.json_escape(F.col("html"))).alias("digest"))


def q_export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, ("", "3", "Channel(s) ", "a/b:", "x.*-+,"))), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", f.export_name(name).alias("name"))


def q_ms_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".25"))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", f.ms_to_seconds(text).alias("seconds"))


def q_export_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, level and tier of `Profile@L4.1@Tier`."""
    text = F.concat("p_brand", F.lit("@L"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit("@Main")).otherwise(""))
    parts = F.split(text, "@")
    level = F.get(F.filter(F.slice(parts, 2, 9), lambda x: F.startswith(x, F.lit("L"))), F.lit(0))
    tier = F.get(F.filter(F.slice(parts, 2, 9), lambda x: ~F.startswith(x, F.lit("L")) & (x != "")), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(parts, F.lit(0)).alias("profile"), F.substring(level, 2, 9).alias("level"), tier.alias("tier"))


def q_track_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/"), F.col("l_suppkey").cast("string"))).otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", f.track_position(text).alias("p")).select("l_orderkey", "p.*")


def q_channel_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    text = F.concat(F.lit("Front: "), F.repeat(F.lit("C "), F.col("p_size") % 4 + 1), F.when(p % 2 == 0, ", Side: L R").otherwise(""), F.when(p % 3 == 0, ", Back: L C R").otherwise(""), F.when(p % 5 == 0, ", LFE").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", f.channel_positions(text).alias("positions"))


def q_subtitle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in the four subtitle formats and read again."""
    ms = (F.col("event_id") * 7919 + 13) % 360_000_000
    part = lambda by, n: ((ms - ms % by) / by).cast("long") % n
    h, m, s, r = part(3_600_000, 1000), part(60_000, 60), part(1000, 60), ms % 1000
    two, three = (lambda x: F.lpad(x.cast("string"), 2, "0")), (lambda x: F.lpad(x.cast("string"), 3, "0"))
    whole = F.concat_ws(":", two(h), two(m), two(s))
    read = lambda mark, pattern, fraction=r: f.clock_to_ms(F.concat(whole, F.lit(mark), three(fraction)), pattern)
    return table(spark, sf_dir, "events").select("event_id", read(",", f.SRT_TIME).alias("srt"), read(".", f.VTT_TIME).alias("vtt"), f.clock_to_ms(F.concat(whole, F.lit("."), F.substring(three(r), 1, 2)), f.ASS_TIME).alias("ass"), read(":", f.VOBSUB_TIME).alias("vobsub"), f.clock_to_ms(F.concat(F.lit("00:60:00"), F.lit(","), three(r)), f.SRT_TIME).alias("bad"))


def q_pts_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, first = (F.col("o_orderkey") * 1_234_567) % (1 << 33), F.lit(1 << 32) + 900_000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(f.unwrapped(ticks, first)).cast("long").alias("ms"))


def q_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame counts as timecodes of 25 frames."""
    code = f.timecode(F.col("l_partkey") * 37, 25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", code.alias("timecode"))


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
_ESCAPED = "regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
_JSON = "replace(replace(replace(replace(replace(html, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
ORACLE = {
    "q_language_normalize": f"{_TAGGED} SELECT doc_id, CASE WHEN code IS NULL THEN base ELSE a END || tail AS normal FROM v",
    "q_language_strings": f"{_TAGGED} SELECT doc_id, CASE WHEN code IS NULL THEN tag ELSE n || CASE WHEN region <> '' THEN ' (' || region || ')' ELSE '' END END AS full, CASE WHEN code IS NULL THEN '' ELSE a || tail END AS two_letters, CASE WHEN code IS NULL THEN '' ELSE t || tail END AS three_letters, CASE WHEN code IS NULL THEN tag ELSE a || tail END AS either FROM v",
    "q_html_lang": f"WITH {_LANGUAGES}, d AS (SELECT page_id, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS tag FROM pages) SELECT page_id, tag, coalesce(n, tag) AS full FROM d LEFT JOIN l ON lower(tag) = code",
    "q_datetime_format": "SELECT event_id, 'UTC ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events",
    "q_epochs": "WITH t AS (SELECT o_orderkey, cast(epoch(o_orderdate) AS BIGINT) AS u, 'UTC ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders) SELECT o_orderkey, u + 2082844800 AS mac, (u + 11644473600) * 10000000 AS ticks, d AS from_mac, d AS from_mkv, d AS from_ticks FROM t",
    "q_extension": "SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '\\?.*$', ''), '^https?://', ''), '[^/]\\.([^./]*)$', 1)) AS extension FROM pages",
    "q_file_parts": "WITH t AS (SELECT page_id, regexp_replace(url, '\\?.*$', '') AS u FROM pages), v AS (SELECT page_id, regexp_extract(u, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(u, '([^/]*)$', 1) AS file FROM t) SELECT page_id, folder, CASE WHEN regexp_matches(file, '^.+\\.[^.]*$') THEN regexp_extract(file, '^(.+)\\.[^.]*$', 1) ELSE file END AS name, regexp_extract(file, '^.+\\.([^.]*)$', 1) AS extension FROM v",
    "q_extension_invalid": "SELECT page_id, page_id % 3 = 1 AS invalid FROM pages",
    "q_clean_text": "SELECT doc_id, regexp_replace(regexp_replace(' ' || chr(9) || substr(text, 1, 100) || chr(1) || chr(31) || chr(10) || ' ' || chr(13), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents",
    "q_decode_text": "SELECT doc_id, strlen(text) AS n_bytes, NOT regexp_matches(text, '[\\x00-\\x08\\x0E-\\x1F]') AS is_text FROM documents",
    "q_xml_escape": f"SELECT page_id, md5({_ESCAPED}) AS digest, length({_ESCAPED}) AS size FROM pages",
    "q_json_escape": f"SELECT page_id, md5('\"' || {_JSON} || '\"') AS digest FROM pages",
    "q_export_name": "WITH t AS (SELECT p_partkey, regexp_replace(regexp_replace(['', '3', 'Channel(s) ', 'a/b:', 'x.*-+,'][p_partkey % 5 + 1] || p_name, '[()]', '', 'g'), '[^\\p{L}\\p{N}_]', '_', 'g') AS n FROM part) SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS name FROM t",
    "q_ms_to_seconds": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN printf('%.3f', o_custkey / 1000.0::DOUBLE) WHEN 1 THEN printf('%.5f', (o_custkey + 0.25::DOUBLE) / 1000.0::DOUBLE) ELSE o_orderpriority END AS seconds FROM orders",
    "q_export_profile": "SELECT p_partkey, p_brand AS profile, p_size::VARCHAR AS level, CASE WHEN p_partkey % 2 = 0 THEN 'Main' END AS tier FROM part",
    "q_track_position": "SELECT l_orderkey, l_linenumber::VARCHAR AS position, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey::VARCHAR ELSE '' END AS total FROM lineitem",
    "q_channel_positions": "SELECT p_partkey, (p_size % 4 + 1) || '/' || CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END || '/' || CASE WHEN p_size % 3 = 0 THEN 3 ELSE 0 END || CASE WHEN p_size % 5 = 0 THEN '.1' ELSE '' END AS positions FROM part",
    "q_subtitle_times": "WITH t AS (SELECT event_id, (event_id * 7919 + 13) % 360000000 AS ms FROM events) SELECT event_id, ms AS srt, ms AS vtt, ms // 10 * 10 AS ass, ms AS vobsub, NULL::BIGINT AS bad FROM t",
    "q_pts_wrap": "WITH t AS (SELECT o_orderkey, (o_orderkey * 1234567) % 8589934592 AS v FROM orders) SELECT o_orderkey, (v + CASE WHEN v + 4294967296 < 4295867296 THEN 8589934592 ELSE 0 END) // 90 AS ms FROM t",
    "q_timecode": "WITH t AS (SELECT l_orderkey, l_partkey, l_partkey * 37 AS n FROM lineitem) SELECT l_orderkey, l_partkey, printf('%02d:%02d:%02d:%02d', n // 90000, n // 1500 % 60, n // 25 % 60, n % 25) AS timecode FROM t",
}
