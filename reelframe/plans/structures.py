"""Queries over nested structures of files: every turn of a conversation acts as a file, whose bytes SQL builds from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators import elements as op
from reelframe.sources.tables import table


def be(n: str, digits: int = 8) -> str:
    return f"printf('%0{digits}x', {n})"


def le(n: str) -> str:
    return "printf('%02x%02x%02x%02x', " + ", ".join(f"({n}) div {256**k} % 256" for k in range(4)) + ")"


def box(kind: str, payload: str) -> str:
    """A box as hexadecimal text; payload: SQL of hexadecimal text."""
    return f"({be(f'length({payload}) div 2 + 8')} || '{kind.encode().hex()}' || {payload})"


def chunk(kind: str, payload: str) -> str:
    return f"('{kind.encode().hex()}' || {le(f'length({payload}) div 2')} || {payload} || CASE WHEN length({payload}) % 4 = 2 THEN '00' ELSE '' END)"


def element(name: str, payload: str) -> str:
    """An element whose size takes four bytes."""
    return f"('{name}' || {be(f'268435456 + length({payload}) div 2')} || {payload})"


#: A turn's text in hexadecimal, its number of tracks, and its form.
_T = "SELECT concat(conv_id, '-', turn) AS file, hex(text) AS h, CAST(length(text) % 3 + 1 AS INT) AS n, CAST((conv_id + turn) % 4 AS INT) AS form FROM {conversations} WHERE text IS NOT NULL"


def staged(content: str, *stages: dict[str, str]) -> str:
    """SQL that adds the columns of each stage to those before, and returns file and h, the content."""
    made = [f"s0 AS ({_T})"] + [f"s{k} AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in stage.items())} FROM s{k - 1})" for k, stage in enumerate(stages, 1)]
    return f"WITH {', '.join(made)} SELECT file, {content} AS h FROM s{len(stages)}"


BOXES = staged(
    f"{box('ftyp', "'69736f6d00000200'")} || moov || mdat",
    {"times": "substr(h, 1, 32)", "sizes": "substr(h, 1, 8)"},
    {"lists": f"{box('stts', 'times')} || {box('stsz', 'sizes')}", "udta": box("udta", "'0000000c6d6574610000000000000008696c7374'")},
    {"stbl": box("stbl", "lists")},
    {"minf": box("minf", "stbl")},
    {"media": f"{box('mdhd', "'00000000'")} || minf"},
    {"track": f"{box('tkhd', "'00'")} || {box('mdia', 'media')}"},
    {"tracks": f"{box('mvhd', "'0000000000000000'")} || repeat({box('trak', 'track')}, n) || udta"},
    {"moov": box("moov", "tracks"), "mdat": f"CASE form WHEN 0 THEN {box('mdat', 'h')} WHEN 1 THEN '000000016d646174' || {be('length(h) div 2 + 16', 16)} || h WHEN 2 THEN '000000006d646174' || h ELSE {be('length(h) div 2 + 108')} || '6d646174' || h END"},
)
CHUNKS = staged(
    f"CASE form WHEN 3 THEN '52494646ffffffff' || riff ELSE {chunk('RIFF', 'riff')} END",
    {"strh": "substr(h, 1, 24)", "strf": "substr(h, 1, 10)", "isft": "substr(h, 1, 14)"},
    {"parts": f"{chunk('strh', 'strh')} || {chunk('strf', 'strf')}", "named": chunk("ISFT", "isft"), "frames": f"{chunk('00dc', 'h')} || '3031776200000000'"},
    {"stream": "'7374726c' || parts", "info": "'494e464f' || named", "movi": "'6d6f7669' || frames"},
    {"streams": chunk("LIST", "stream"), "info_list": chunk("LIST", "info"), "movi_list": chunk("LIST", "movi")},
    {"header": "'6864726c6176696805000000000000000000' || repeat(streams, n)"},
    {"riff": f"'41564920' || {chunk('LIST', 'header')} || info_list || movi_list"},
)
EBML = staged(
    f"{element('1A45DFA3', "'4282100000047765626d'")} || '18538067' || CASE WHEN form % 2 = 0 THEN '01FFFFFFFFFFFFFF' ELSE {be('268435456 + length(body) div 2')} END || body",
    {"video": element("E0", "'B0100000020280'"), "block": element("A3", "h")},
    {"track": f"{element('D7', "'01'")} || video", "cluster": f"{element('E7', "'00'")} || block"},
    {"tracks": f"repeat({element('AE', 'track')}, n)", "info": element("2AD7B1", "'0F4240'")},
    {"body": f"{element('1549A966', 'info')} || {element('1654AE6B', 'tracks')} || CASE WHEN form < 2 THEN {element('1F43B675', 'cluster')} ELSE '1F43B67501FFFFFFFFFFFFFF' || cluster END"},
)


def files(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    made = spark.sql(sql, conversations=table(spark, sf_dir, "conversations"))
    return made.select("file", F.unhex("h").alias("content"))


def q_boxes_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.elements(files(spark, sf_dir, BOXES), op.BOXES)


def q_chunks_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.elements(files(spark, sf_dir, CHUNKS), op.CHUNKS)


def q_ebml_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.elements(files(spark, sf_dir, EBML), op.EBML)


def _duck(sql: str) -> str:
    return sql.replace("{conversations}", "conversations").replace(" div ", " // ")


def _walk(made: str, read: str, containers: dict[str, int], step: str = "e.stop", pad: str = "0") -> str:
    """A row for each element: the next sibling and the first child of each one are the next rows. read: (id, size, header, opened) at s."""
    table_of = ", ".join(f"('{k}', {v})" for k, v in containers.items())
    return f"""WITH RECURSIVE f AS MATERIALIZED ({_duck(made)}), g(id, skip) AS (VALUES {table_of}),
q AS (SELECT file, h, ''::VARCHAR AS above, 0 AS depth, NULL::BIGINT AS parent, 0::BIGINT AS s, (length(h) // 2)::BIGINT AS lim FROM f),
w AS (SELECT * FROM (SELECT q.*, {read} FROM q) WHERE ok
 UNION ALL SELECT * FROM (SELECT q.*, {read} FROM (
  SELECT w.file, w.h, CASE WHEN k = 0 THEN w.above ELSE w.path END AS above, w.depth + k AS depth, CASE WHEN k = 0 THEN w.parent ELSE w.s END AS parent,
   CASE WHEN k = 0 THEN w.nxt ELSE w.head + g.skip END AS s, CASE WHEN k = 0 THEN w.lim ELSE w.stop END AS lim
  FROM w CROSS JOIN (VALUES (0), (1)) AS v(k) LEFT JOIN g ON g.id = w.id WHERE k = 0 OR (g.id IS NOT NULL AND w.depth < 7)) AS q) WHERE ok)
SELECT file, path, id, depth, parent, s AS start, head, stop AS end, CASE WHEN depth = 7 AND id IN (SELECT id FROM g) THEN 'deep' ELSE state END AS state FROM w"""


def _number(at: str, digits: int = 8) -> str:
    return f"('0x0' || substr(h, (2 * ({at}) + 1)::BIGINT, {digits}))::BIGINT"


def _safe(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def _columns(name: str, size: str, header: str, opened: str, ok: str, pad: bool = False, flat: str = "false") -> str:
    """id, head, stop, state, nxt, path and ok of the element at s; size without the header."""
    stop = f"CASE WHEN {opened} AND {flat} THEN s + {header} WHEN {opened} OR s + {header} + {size} > lim THEN lim ELSE s + {header} + {size} END"
    nxt = f"({stop}) + CASE WHEN (({stop}) - s) % 2 <> {header} % 2 THEN 1 ELSE 0 END" if pad else stop
    return f"""{name} AS id, (s + {header})::BIGINT AS head, ({stop})::BIGINT AS stop, CASE WHEN {opened} THEN 'open' WHEN s + {header} + {size} > lim THEN 'cut' ELSE 'whole' END AS state,
 ({nxt})::BIGINT AS nxt, CASE WHEN above = '' THEN {name} ELSE above || '/' || {name} END AS path, coalesce({ok}, false) AS ok"""


_FITS = "s + 8 <= lim"
_FOURCC = "decode(unhex(substr(h, (2 * (s + {0}) + 1)::BIGINT, 8)))"
_BOX = _columns(
    _safe(_FITS, _FOURCC.format(4)), _safe(_FITS, f"CASE WHEN {_number('s')} = 1 THEN {_number('s + 8', 16)} - 16 ELSE {_number('s')} - 8 END"),
    _safe(_FITS, f"CASE WHEN {_number('s')} = 1 THEN 16 ELSE 8 END"), _safe(_FITS, f"{_number('s')} = 0"), _FITS,
)
_LE = "('0x' || substr(h, (2 * s + 15)::BIGINT, 2) || substr(h, (2 * s + 13)::BIGINT, 2) || substr(h, (2 * s + 11)::BIGINT, 2) || substr(h, (2 * s + 9)::BIGINT, 2))::BIGINT"
_CHUNK = _columns(_safe(_FITS, _FOURCC.format(0)), _safe(_FITS, _LE), "8", _safe(_FITS, f"{_LE} = 4294967295"), _FITS, pad=True)
_B0 = _number("s", 2)
_W = f"(CASE WHEN {_B0} >= 128 THEN 1 WHEN {_B0} >= 64 THEN 2 WHEN {_B0} >= 32 THEN 3 ELSE 4 END)"
_B1 = _number(f"s + {_W}", 2)
_EBML = _columns(
    _safe("s + 2 <= lim", f"substr(h, (2 * s + 1)::BIGINT, 2 * {_W})"), _safe("s + 2 <= lim", f"CASE WHEN {_B1} = 1 THEN 0 ELSE {_number(f's + {_W}')} - 268435456 END"),
    f"(CASE WHEN s + 2 <= lim THEN {_W} + CASE WHEN {_B1} = 1 THEN 8 ELSE 4 END END)", _safe("s + 2 <= lim", f"{_B1} = 1"), "s + 2 <= lim", flat="depth > 0",
)

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
ORACLE = {
    "q_boxes_tree": _walk(BOXES, _BOX, op.BOXES.containers),
    "q_chunks_tree": _walk(CHUNKS, _CHUNK, op.CHUNKS.containers),
    "q_ebml_tree": _walk(EBML, _EBML, op.EBML.containers),
}
