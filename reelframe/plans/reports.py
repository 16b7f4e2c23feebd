"""Queries over the field layouts, the field interface and the renderers: parts and their stock act as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators import fields as op
from reelframe.plans.streams import _STREAMS, streams_of
from reelframe.sources.tables import table

_FIELDS = ["format", "hint", "language", "mode", "size"]
_ROWS = "r AS (SELECT file, idx, kind, u.* FROM t, LATERAL (VALUES (0, 'format', format), (1, 'hint', hint), (2, 'language', language), (3, 'mode', mode), (4, 'size', size::VARCHAR)) AS u(pos, name, text) WHERE coalesce(text, '') <> '')"
_KIND_ID = "CASE kind WHEN 'Video' THEN 1 WHEN 'Audio' THEN 2 ELSE 3 END"


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "Video", 1).when(F.col("kind") == "Audio", 2).otherwise(3)
    return streams_of(spark, sf_dir).withColumn("kind_id", kind)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.to_rows(_streams(spark, sf_dir), ["file", "kind_id", "kind", "idx"], _FIELDS)


def q_eav_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).drop("kind_id")


def q_eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.to_columns(_rows(spark, sf_dir), ["file", "idx"], _FIELDS)


def q_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.get(_rows(spark, sf_dir), ["file", "idx"], "mode")


def q_geti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.get_at(_rows(spark, sf_dir), ["file", "idx"], 2)


def q_count_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_get(_rows(spark, sf_dir), ["file", "idx"], 4)


def q_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_report(_streams(spark, sf_dir), fields=_FIELDS)


_HEADED = f"WITH {_STREAMS}, {_ROWS}, h AS (SELECT *, {_KIND_ID} AS k, dense_rank() OVER (PARTITION BY file, kind ORDER BY idx) AS p FROM r), c AS (SELECT *, max(p) OVER (PARTITION BY file, kind) AS among FROM h)"


def _report(line: str, head: str, tail: str, outer: str = "''") -> str:
    return f"{_HEADED}, s AS (SELECT file, k, idx, {head} || string_agg({line}, '' ORDER BY pos) || {tail} AS x FROM c GROUP BY file, k, idx, kind, p, among) SELECT file, string_agg(x, {outer} ORDER BY k, idx) AS report FROM s GROUP BY file"


def q_xml_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.xml_report(_streams(spark, sf_dir), fields=_FIELDS)


def q_oldxml_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.xml_report(_streams(spark, sf_dir), old=True, fields=_FIELDS)


def q_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.json_report(_streams(spark, sf_dir), fields=_FIELDS)


def q_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams_of(spark, sf_dir)
    names = {n: F.col(n) for n in ("format", "hint", "language", "size")}
    return rows.select("file", "idx", op.template("%format%\\t[%hint%] %nothing%100% %size%\\n", names).alias("line"))


def q_template_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams_of(spark, sf_dir)
    names = {n: F.col(n) for n in ("format", "hint", "language")}
    return rows.select("file", "idx", op.template("%format%$if(%hint%, (%hint%),)$if(%language%,: %language%,: none)", names).alias("line"))


def q_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("BitRate", "BitRate/String", "Width/String3", "Unknown"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", op.label(name, {"BitRate": "Bit rate", "Width": "Width in pixels"}).alias("label"))


def q_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("tag"), F.col("p_name").alias("text"))
    return op.mapped_tags(tags, {"ECONOMY": "Title", "STANDARD": "Album", "PROMO": "Performer"}).select("p_partkey", "name", "text", "extra")


def q_compare_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mine = p.filter("p_partkey % 10 <> 0").select("p_partkey", F.col("p_name").alias("text"))
    other = p.filter("p_partkey % 7 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("text"))
    return op.compared(mine, other, ["p_partkey"], "text")


def q_allow_list_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mine, other = p.select("p_partkey", F.col("p_name").alias("text")), p.filter("p_partkey % 7 <> 0").select("p_partkey", F.col("p_name").alias("text"))
    return op.compared(mine, other, ["p_partkey"], "text", p.filter("p_partkey % 14 = 0").select("p_partkey")).select("p_partkey", "state")


def q_golden_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of heading and field lines read back into field rows by a running count of headings."""
    rows = _rows(spark, sf_dir)
    head = rows.groupBy("file", "kind_id", "kind", "idx").agg(F.count(F.lit(1)).alias("n"))
    lines = head.select("file", "idx", F.lit(-1).alias("pos"), F.concat(F.lit("== "), "kind", F.lit(" #"), F.col("idx").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(" fields)")).alias("line"))
    lines = lines.unionByName(rows.select("file", "idx", "pos", F.concat("name", F.lit("\t"), F.replace("text", F.lit("\n"), F.lit("\\n"))).alias("line")))
    from pyspark.sql import Window

    number = F.sum(F.startswith("line", F.lit("== ")).cast("int")).over(Window.partitionBy("file").orderBy("idx", "pos").rowsBetween(Window.unboundedPreceding, 0))
    read = lines.withColumn("stream", number).filter(~F.startswith("line", F.lit("== ")))
    return read.select("file", F.col("stream").cast("int").alias("stream"), F.split_part("line", F.lit("\t"), F.lit(1)).alias("name"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("text"))


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
_XML_HEAD = "'<track type=\"' || kind || CASE WHEN among > 1 THEN '\" {0}=\"' || p ELSE '' END || '\">' || chr(10)"
_XML_LINE = "'<' || name || '>' || text || '</' || name || '>' || chr(10)"
ORACLE = {
    "q_eav_unpivot": f"WITH {_STREAMS}, {_ROWS} SELECT file, kind, idx, pos, name, text FROM r",
    "q_eav_pivot": f"WITH {_STREAMS}, {_ROWS} SELECT file, idx, " + ", ".join(f"max(text) FILTER (name = '{n}') AS {n}" for n in _FIELDS) + " FROM r GROUP BY file, idx",
    "q_get": f"WITH {_STREAMS}, {_ROWS} SELECT file, idx, coalesce(max(text) FILTER (name = 'mode'), '') AS text FROM r GROUP BY file, idx",
    "q_geti": f"WITH {_STREAMS}, {_ROWS} SELECT file, idx, name, text FROM r WHERE pos = 2",
    "q_count_get": f"WITH {_STREAMS}, {_ROWS} SELECT file, idx, 4 + count(*) FILTER (pos >= 4) AS count FROM r GROUP BY file, idx",
    "q_text_report": _report("CASE WHEN length(name) >= 41 THEN name ELSE rpad(name, 41, ' ') END || ': ' || text || chr(10)", "kind || CASE WHEN among > 1 THEN ' #' || p ELSE '' END || chr(10)", "chr(10)"),
    "q_xml_report": _report(_XML_LINE, _XML_HEAD.format("typeorder"), "'</track>' || chr(10)"),
    "q_oldxml_report": _report(_XML_LINE, _XML_HEAD.format("streamid"), "'</track>' || chr(10)"),
    "q_json_report": _report("',' || chr(10) || '\"' || name || '\": \"' || text || '\"'", "'{' || chr(10) || '\"@type\": \"' || kind || '\"' || CASE WHEN among > 1 THEN ',' || chr(10) || '\"@typeorder\": \"' || p || '\"' ELSE '' END", "chr(10) || '}'", "',' || chr(10)"),
    "q_template": f"WITH {_STREAMS} SELECT file, idx, format || chr(9) || '[' || hint || '] 100' || 'size%' || chr(10) AS line FROM t",
    "q_template_if": f"WITH {_STREAMS} SELECT file, idx, format || CASE WHEN hint <> '' THEN ' (' || hint || ')' ELSE '' END || CASE WHEN coalesce(language, '') <> '' THEN ': ' || language ELSE ': none' END AS line FROM t",
    "q_label": "SELECT p_partkey, ['Bit rate', 'Bit rate', 'Width in pixels', 'Unknown'][p_partkey % 4 + 1] AS label FROM part",
    "q_tag_map": "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Title' WHEN 'STANDARD' THEN 'Album' WHEN 'PROMO' THEN 'Performer' ELSE lower(p_type) END AS name, p_name AS text, p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') AS extra FROM part",
    "q_compare_outer": "WITH a AS (SELECT p_partkey, p_name AS mine FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS other FROM part WHERE p_partkey % 7 <> 0) SELECT p_partkey, mine, other, CASE WHEN mine IS NULL THEN 'missing' WHEN other IS NULL THEN 'extra' ELSE 'different' END AS state FROM a FULL JOIN b USING (p_partkey) WHERE mine IS DISTINCT FROM other",
    "q_allow_list_anti": "SELECT p_partkey, 'extra' AS state FROM part p WHERE p_partkey % 7 = 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey AND q.p_partkey % 14 = 0)",
    "q_golden_dump": f"WITH {_STREAMS}, {_ROWS} SELECT file, dense_rank() OVER (PARTITION BY file ORDER BY idx)::INTEGER AS stream, name, text FROM r",
}
