"""Queries over placed fields and their reports: a conversation acts as a file, its turns as streams whose fields SQL sets one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelframe.functions import schema
from reelframe.operators import schema as op
from reelframe.operators import tagmaps
from reelframe.sources.tables import table

#: name, SQL of the text, measure and options, in the order in which the fields are set.
_GENERAL = [
    ("CompleteName", "concat('/media/', file, ' & co.mkv')", None, None), ("Format", "'Matroska'", None, None), ("Mood", "CASE WHEN l % 2 = 0 THEN 'calm' ELSE '' END", None, None),
    ("Duration", "CAST(l * 7 AS STRING)", None, None), ("Title", "'first'", None, None), ("Title", "CASE WHEN l % 3 > 0 THEN concat('take ', l) END", None, None),
    ("Format_Version", "concat('Version ', l % 4)", None, None), ("Count", "'99'", None, None), ("conformance", "'a < b'", "", "N YTY"),
]
_STREAM = [
    ("Format", "CASE kind WHEN 'Video' THEN 'AVC' ELSE 'AAC' END", None, None), ("Note", "substr(text, 1, 30)", None, None),
    ("Format_Profile", "CASE l % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Main@L4.1@High' WHEN 2 THEN 'LC@L2' ELSE '@Main@L3@L5' END", None, None), ("Width", "CASE WHEN l % 5 > 0 THEN CAST(l AS STRING) END", " px", "Y NT"),
    ("Width/String", "concat(l, ' pixels')", None, None), ("dialnorm", "CAST(0 - l % 31 AS STRING)", " dB", "N YTY"), ("Duration", "CAST(l AS STRING)", None, None), ("Note", "concat('\"', substr(text, 3, 12), '\\\\')", None, None),
    ("BitRate/String", "concat(l, ' b/s')", None, None), ("Bits/x", "'1'", None, "Y NN"),
]
_TURNS = "CAST(conv_id AS STRING) AS file, CASE role WHEN 'user' THEN 'Video' ELSE 'Audio' END AS kind, CAST(turn AS INT) AS idx, text, CAST(length(text) AS BIGINT) AS l FROM {conversations} WHERE text IS NOT NULL"
_FIRST = "CAST(conv_id AS STRING) AS file, 'General' AS kind, 0 AS idx, text, CAST(length(text) AS BIGINT) AS l FROM {conversations} WHERE turn = 0 AND text IS NOT NULL"


def _quoted(x: str | None) -> str:
    return "CAST(NULL AS STRING)" if x is None else f"'{x}'"


def _set(source: str, fields: list[tuple], spark: bool) -> str:
    rows = [(f"{k}", f"'{name}'", text, _quoted(measure), _quoted(options)) for k, (name, text, measure, options) in enumerate(fields)]
    if spark:
        return f"SELECT file, kind, idx, stack({len(rows)}, {', '.join(', '.join(r) for r in rows)}) AS (seq, name, text, measure, options) FROM (SELECT {source})"
    rows = ", ".join(f"({', '.join(r)})" for r in rows).replace("\\\\", "\\")
    return f"SELECT file, kind, idx, u.* FROM (SELECT {source.replace('{conversations}', 'conversations')}) AS s, LATERAL (VALUES {rows}) AS u(seq, name, text, measure, options)"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return spark.sql(f"{_set(_FIRST, _GENERAL, True)} UNION ALL {_set(_TURNS, _STREAM, True)}", conversations=rows)


def q_schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.placed(fields(spark, sf_dir))


def q_schema_get_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure of the eleventh slot, whether it has a value or not."""
    return op.get_at(fields(spark, sf_dir), schema.core(spark), 11, "measure")


def q_schema_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.get(fields(spark, sf_dir), "Title")


def q_schema_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.count_get(fields(spark, sf_dir), schema.core(spark))


def q_inform_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inform(fields(spark, sf_dir))


def q_inform_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inform(fields(spark, sf_dir), op.Options().option("Output", "XML")[1])


def q_inform_oldxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inform(fields(spark, sf_dir), op.Options().option("Inform", "OLDXML")[1])


def q_inform_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inform(fields(spark, sf_dir), op.Options().option("Output", "json")[1])


#: Keys of two sources: source, key, field, rule, part.
TAG_MAPS = [("id3", "tit2", "Title", "first", None), ("id3", "TPE1", "Performer", "join", None), ("id3", "TRCK", "Track/Position", "last", "position"), ("ape", "Title", "Title", "first", None), ("ape", "ARTIST", "Performer", "join", None), ("ape", "comment", "Comment", "last", None)]


def q_tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of two sources of a file, with keys that both know, that repeat, and that neither knows."""
    keys = "element_at(array('TIT2', 'TPE1', 'TRCK', 'Title', 'artist', 'COMMENT', 'x'), CAST(length(text) % 7 + 1 AS INT))"
    tags = spark.sql(f"SELECT CAST(conv_id AS STRING) AS file, CASE role WHEN 'user' THEN 'id3' ELSE 'ape' END AS source, turn AS seq, {keys} AS key, CASE WHEN length(text) % 7 = 2 THEN concat(turn, '/ ', length(text)) ELSE concat('v', length(text) % 5) END AS text FROM {{conversations}}", conversations=table(spark, sf_dir, "conversations"))
    rows = ", ".join(f"({', '.join(_quoted(x) for x in row)})" for row in TAG_MAPS)
    return tagmaps.resolved(tags, spark.sql(f"SELECT * FROM VALUES {rows} AS t(source, key, field, rule, part)"), ["ape", "id3"])


TEMPLATE = "General;%CompleteName% (%Title%)$if(%Mood%, %Mood%,)\\nVideo;%Width%x%Height%: %Note%\\n--\\nAudio;$if(%Width%,wide,narrow) %Format%\\n"


def q_inform_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inform(fields(spark, sf_dir), op.Options().option("Inform", TEMPLATE)[1])


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
_DIMENSION = ", ".join(f"({', '.join(repr(x) for x in (*row, schema.label_of(row[2], schema.labels())))})" for row in schema.core_rows())
_LABELS = " ".join(f"WHEN {name!r} THEN {text!r}" for name, text in schema.labels().items())
_NUMBERS = "CASE kind WHEN 'General' THEN 1 WHEN 'Video' THEN 2 ELSE 3 END"
_PLACED = f"""WITH a AS MATERIALIZED ({_set(_FIRST, _GENERAL, False)} UNION ALL {_set(_TURNS, _STREAM, False)}), d(kind, slot, name, measure, options, label) AS (VALUES {_DIMENSION}),
z AS (SELECT kind, max(slot) + 1 AS slots FROM d GROUP BY kind),
g AS (SELECT file, kind, idx, name, min(seq) AS first, arg_max({{'t': text, 'm': measure, 'o': options}}, seq) AS x FROM a GROUP BY ALL),
j AS (SELECT g.*, d.slot, d.measure AS dm, d.options AS dop, d.label, row_number() OVER (PARTITION BY file, g.kind, idx, d.slot IS NULL ORDER BY first, g.name) - 1 + slots AS behind FROM g LEFT JOIN d ON d.kind = g.kind AND d.name = g.name JOIN z ON z.kind = g.kind),
p AS (SELECT file, kind, idx, coalesce(slot, behind)::INTEGER AS pos, name, x.t AS text, CASE WHEN slot IS NULL THEN coalesce(x.m, '') ELSE dm END AS measure, CASE WHEN slot IS NULL THEN coalesce(x.o, 'Y NT') ELSE dop END AS options,
 CASE WHEN slot IS NULL THEN CASE name {_LABELS} ELSE name END ELSE label END AS label, slot IS NULL AS dynamic FROM j WHERE coalesce(x.t, '') <> ''),
s AS (SELECT file, kind, idx, row_number() OVER (PARTITION BY file, kind ORDER BY idx) AS place, count(*) OVER (PARTITION BY file, kind) AS among, {_NUMBERS} AS k FROM (SELECT DISTINCT file, kind, idx FROM p))"""
_NAME = "regexp_replace(regexp_replace({0}, '[()]', '', 'g'), '[^A-Za-z0-9_]', '_', 'g')"
_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_JSON = "'\"' || replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'"
_PAIRS = f"""{_PLACED},
e AS (SELECT file, kind, idx, pos, dynamic, unnest(CASE WHEN measure = ' ms' THEN [{{'n': name, 'v': printf('%.3f', text::DOUBLE / 1000), 'k': 1::BIGINT}}] WHEN name = 'Format_Version' THEN [{{'n': name, 'v': regexp_replace(text, '^Version ', ''), 'k': 1::BIGINT}}]
 WHEN name = 'Format_Profile' THEN list_transform(list_filter(string_split(text, '@'), lambda y, i: i = 1 OR y <> ''), lambda y, i: CASE WHEN i = 1 THEN {{'n': 'Format_Profile', 'v': y, 'k': i::BIGINT}} WHEN starts_with(y, 'L') THEN {{'n': 'Format_Level', 'v': substr(y, 2), 'k': i::BIGINT}} ELSE {{'n': 'Format_Tier', 'v': y, 'k': i::BIGINT}} END)
 ELSE [{{'n': name, 'v': text, 'k': 1::BIGINT}}] END) AS x FROM p WHERE (dynamic OR substr(options, 5, 1) = 'Y') AND name NOT IN ({', '.join(repr(x) for x in op.INNER)})),
f AS (SELECT file, kind, idx, pos, dynamic, x.n AS n, x.v AS v, row_number() OVER (PARTITION BY file, kind, idx, x.n ORDER BY pos, x.k) AS again, x.k AS nth FROM e),
h AS (SELECT * FROM f WHERE v <> '' AND (again = 1 OR n NOT IN ('Format_Level', 'Format_Tier'))), c AS (SELECT file, max(text) AS complete FROM p WHERE kind = 'General' AND name = 'CompleteName' GROUP BY file)"""


def _text(head: str, line: str, tail: str, between: str, where: str, start: str, end: str) -> str:
    return f"""{_PLACED}, l AS (SELECT file, kind, idx, string_agg({line}, '' ORDER BY pos) FILTER ({where}) AS lines FROM p GROUP BY file, kind, idx)
SELECT file, {start} || string_agg({head} || coalesce(lines, '') || {tail}, {between} ORDER BY k, idx) || {end} AS report FROM s JOIN l USING (file, kind, idx) GROUP BY file"""


def _pairs(head: str, line: str, extra: str, tail: str, between: str, start: str, end: str) -> str:
    return f"""{_PAIRS}, l AS (SELECT file, kind, idx, coalesce(string_agg({line}, '' ORDER BY pos, nth) FILTER (NOT dynamic), '') AS lines, string_agg({line}, '' ORDER BY pos, nth) FILTER (dynamic) AS more FROM h GROUP BY file, kind, idx)
SELECT file, {start} || string_agg({head} || coalesce(lines, '') || CASE WHEN more IS NULL THEN '' ELSE {extra} END || {tail}, {between} ORDER BY k, idx) || {end} AS report FROM s LEFT JOIN l USING (file, kind, idx) LEFT JOIN c USING (file) GROUP BY file"""


_ELEMENT = "'<' || {0} || '>' || {1} || '</' || {0} || '>' || chr(10)"
_TRACK = "'<track type=\"' || kind || CASE WHEN among > 1 THEN '\" {0}=\"' || place ELSE '' END || '\">' || chr(10)"
_HEAD = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || "
_FIELD = "coalesce(max(text) FILTER (name = '{0}'), '')"
_MAPS = ", ".join(f"({', '.join(_quoted(x).replace('STRING', 'VARCHAR') for x in row)})" for row in TAG_MAPS)
_TAGS = f"""WITH t AS (SELECT conv_id::VARCHAR AS file, CASE role WHEN 'user' THEN 'id3' ELSE 'ape' END AS source, turn AS seq, ['TIT2', 'TPE1', 'TRCK', 'Title', 'artist', 'COMMENT', 'x'][length(text) % 7 + 1] AS key,
 CASE WHEN length(text) % 7 = 2 THEN turn || '/ ' || length(text) ELSE 'v' || length(text) % 5 END AS text FROM conversations WHERE text IS NOT NULL), m(source, k, field, rule, part) AS (VALUES {_MAPS}),
j AS (SELECT t.*, m.field, coalesce(m.rule, 'first') AS rule, m.field IS NULL AS extra, m.part, CASE t.source WHEN 'ape' THEN 1 ELSE 2 END AS place FROM t LEFT JOIN m ON m.source = t.source AND upper(m.k) = upper(t.key)),
p AS (SELECT file, coalesce(field, key) AS field, rule, extra, place, seq, CASE WHEN part IS NULL THEN text ELSE trim(split_part(text, '/', 1)) END AS text FROM j UNION ALL SELECT file, field || '_Total', rule, extra, place, seq, trim(split_part(text, '/', 2)) FROM j WHERE part IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY file, field ORDER BY place, seq) AS a, row_number() OVER (PARTITION BY file, field ORDER BY place DESC, seq DESC) AS z, row_number() OVER (PARTITION BY file, field, text ORDER BY place, seq) AS d FROM p WHERE text <> '')
SELECT file, field, CASE max(rule) FILTER (a = 1) WHEN 'join' THEN string_agg(text, ' / ' ORDER BY place, seq) FILTER (d = 1) WHEN 'last' THEN max(text) FILTER (z = 1) ELSE max(text) FILTER (a = 1) END AS text, bool_or(extra) FILTER (a = 1) AS extra FROM n GROUP BY file, field"""
ORACLE = {
    "q_tag_rules": _TAGS,
    "q_schema_fields": f"{_PLACED} SELECT * FROM p",
    "q_schema_get_at": f"{_PLACED} SELECT file, kind, idx, CASE kind WHEN 'Video' THEN ' ms' WHEN 'Audio' THEN ' ms' ELSE '' END AS value FROM (SELECT DISTINCT file, kind, idx FROM a)",
    "q_schema_get": f"{_PLACED} SELECT file, kind, idx, coalesce(max(x.t) FILTER (name = 'Title'), '') AS text FROM g GROUP BY ALL",
    "q_schema_count": f"{_PLACED} SELECT file, kind, idx, any_value(slots) + count(*) FILTER (slot IS NULL) AS count FROM j JOIN z USING (kind) GROUP BY file, kind, idx",
    "q_inform_text": _text("kind || CASE WHEN among > 1 THEN ' #' || place ELSE '' END || chr(10)", "CASE WHEN length(label) >= 41 THEN label ELSE rpad(label, 41, ' ') END || ': ' || text || chr(10)", "''", "chr(10)", "substr(options, 1, 1) = 'Y'", "''", "chr(10)"),
    "q_inform_oldxml": _text(_TRACK.format("streamid"), _ELEMENT.format(f"replace({_NAME.format('label')}, '__', '_')", _XML.format("text")), "'</track>' || chr(10)", "''", "substr(options, 1, 1) = 'Y'", f"{_HEAD}'<MediaReport version=\"1.0\">' || chr(10) || '<File>' || chr(10)", "'</File>' || chr(10) || '</MediaReport>' || chr(10)"),
    "q_inform_xml": _pairs(
        _TRACK.format("typeorder"), _ELEMENT.format(_NAME.format("n"), _XML.format("v")), "'<extra>' || chr(10) || more || '</extra>' || chr(10)", "'</track>' || chr(10)", "''",
        f"{_HEAD}'<MediaReport' || chr(10) || '    xmlns=\"urn:reelframe:media:2.0\"' || chr(10) || '    version=\"2.0\">' || chr(10) || '<creatingLibrary version=\"1.0\" url=\"urn:reelframe\">reelframe</creatingLibrary>' || chr(10) || '<media ref=\"' || {_XML.format('coalesce(max(complete), %s)' % repr(''))} || '\">' || chr(10)",
        "'</media>' || chr(10) || '</MediaReport>' || chr(10)",
    ),
    "q_inform_json": _pairs(
        "'{' || chr(10) || '\"@type\": \"' || kind || '\"' || CASE WHEN among > 1 THEN ',' || chr(10) || '\"@typeorder\": \"' || place || '\"' ELSE '' END", f"',' || chr(10) || {_JSON.format(_NAME.format('n'))} || ': ' || {_JSON.format('v')}",
        "',' || chr(10) || '\"extra\": {' || chr(10) || substr(more, 3) || chr(10) || '}'", "chr(10) || '}'", "',' || chr(10)",
        f"'{{' || chr(10) || '\"creatingLibrary\": {{' || chr(10) || '\"name\": \"reelframe\",' || chr(10) || '\"version\": \"1.0\",' || chr(10) || '\"url\": \"urn:reelframe\"' || chr(10) || '}},' || chr(10) || '\"media\": {{' || chr(10) || '\"@ref\": ' || {_JSON.format('coalesce(max(complete), %s)' % repr(''))} || ',' || chr(10) || '\"track\": [' || chr(10)",
        "chr(10) || ']' || chr(10) || '}' || chr(10) || '}' || chr(10)",
    ),
    "q_inform_sections": f"""{_PLACED}, v AS (SELECT file, kind, idx, {', '.join(f'{_FIELD.format(n)} AS "{n}"' for n in ('CompleteName', 'Title', 'Mood', 'Width', 'Height', 'Note', 'Format'))} FROM p GROUP BY file, kind, idx)
SELECT file, string_agg(CASE kind WHEN 'General' THEN "CompleteName" || ' (' || "Title" || ')' || CASE WHEN "Mood" <> '' THEN ' ' || "Mood" ELSE '' END || chr(10)
 WHEN 'Video' THEN "Width" || 'x' || "Height" || ': ' || "Note" || chr(10) || '--' || chr(10) ELSE CASE WHEN "Width" <> '' THEN 'wide' ELSE 'narrow' END || ' ' || "Format" || chr(10) END, '' ORDER BY {_NUMBERS}, idx) AS report FROM v GROUP BY file""",
}
