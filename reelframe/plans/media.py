"""Queries over the media source: headers written from table columns are parsed again, texts are sniffed, cues counted."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.sources import media
from reelframe.sources.tables import table


def _packed(frame: DataFrame, build: Callable[..., bytes]) -> DataFrame:
    """key and content: a file's bytes built from the other columns.

    The rows are dealt out by key first: a small table is one task's reading, but its files are much more work.
    """
    spark = frame.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *columns = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in key], pa.string()), pa.array([build(*x) for x in zip(*columns, strict=True)], pa.binary())], ["file", "content"])

    return frame.repartition(tasks, frame.columns[0]).mapInArrow(rows, "file string, content binary")


def _fields(files: DataFrame, kind: str, *names: str) -> DataFrame:
    rows = media.stream_rows(files).filter(F.col("kind") == kind)
    return rows.select("file", "format", *(F.element_at("fields", n).alias(n.lower().replace("(s)", "s")) for n in names))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).cast("long").alias("w"), (F.col("p_partkey") % 1000 + 1).cast("long").alias("h"))


def build_png(w: int, h: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0) + b"\0" * 4


def build_gif(w: int, h: int) -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0)


def build_bmp(w: int, h: int) -> bytes:
    return b"BM" + struct.pack("<IHHIIiiHH", 200, 0, 0, 54, 40, w, -h, 1, 24) + b"\0" * 150


def build_wave(w: int, h: int) -> bytes:
    data = b"\0" * 4 * h
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, w * 100, w * 400, 4, 16) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def build_au(w: int, h: int) -> bytes:
    return b".snd" + struct.pack(">IIIII", 24, 4 * h, 3, w * 100, 2) + b"\0" * 4


def build_aiff(w: int, h: int) -> bytes:
    rate, exponent = w * 100, (w * 100).bit_length() - 1
    comm = struct.pack(">hIhHQ", 2, h, 16, 16383 + exponent, rate << 63 - exponent)
    return b"FORM" + struct.pack(">I", 4 + 8 + len(comm)) + b"AIFFCOMM" + struct.pack(">I", len(comm)) + comm


def build_flac(w: int, h: int) -> bytes:
    return b"fLaC\x80\0\0\x22" + struct.pack(">HH", 4096, 4096) + b"\0" * 6 + (w * 100 << 44 | 1 << 41 | 15 << 36 | h * 100).to_bytes(8, "big") + b"\0" * 16


def build_ivf(w: int, h: int) -> bytes:
    frames = [b"x" * (k % 7 + 1) for k in range(h % 20 + 1)]
    return b"DKIF\0\0\x20\0VP90" + struct.pack("<HHIIII", w, h, 25, 1, len(frames), 0) + b"".join(struct.pack("<IQ", len(f), k) + f for k, f in enumerate(frames))


def _image_query(build: Callable[[int, int], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _fields(_packed(_parts(spark, sf_dir), build), "Image", "Width", "Height", "BitDepth")


def _sound_query(build: Callable[[int, int], bytes]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _fields(_packed(_parts(spark, sf_dir), build), "Audio", "Channel(s)", "SamplingRate", "BitDepth", "Duration")


q_png_roundtrip, q_gif_roundtrip, q_bmp_roundtrip = map(_image_query, (build_png, build_gif, build_bmp))
q_wav_roundtrip, q_au_roundtrip, q_aiff_roundtrip, q_flac_roundtrip = map(_sound_query, (build_wave, build_au, build_aiff, build_flac))


def q_ivf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_packed(_parts(spark, sf_dir), build_ivf), "Video", "CodecID", "Width", "Height", "FrameCount", "Duration")


def build_adts(w: int, h: int) -> bytes:
    size = 7 + h
    head = bytes([0xFF, 0xF1, 1 << 6 | (w // 16 % 13) << 2, 2 << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC])
    return (head + b"\0" * h) * 3


def q_adts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_packed(_parts(spark, sf_dir), build_adts), "Audio", "Channel(s)", "SamplingRate", "FrameCount")


def build_mp3(w: int, h: int) -> bytes:
    head = bytes([0xFF, 0xFB, (w // 16 % 14 + 1) << 4, 0])
    return (head + b"\0" * (media.mpeg_header(head, 0)[4] - 4)) * 3


def q_mp3_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_packed(_parts(spark, sf_dir), build_mp3), "Audio", "Format_Profile", "SamplingRate", "BitRate", "FrameCount")


def build_ac3(w: int, h: int) -> bytes:
    kbits = media.AC3_KBITS[w // 16 % 19]
    return (b"\x0b\x77\0\0" + bytes([(w // 16 % 19) << 1, 8 << 3, 2 << 5]) + b"\0" * (4 * kbits - 7)) * 3


def q_ac3_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_packed(_parts(spark, sf_dir), build_ac3), "Audio", "Channel(s)", "BitRate", "Duration")


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


def build_mp4(w: int, h: int) -> bytes:
    entry = box(b"avc1", b"\0" * 24 + struct.pack(">HH", w, h) + b"\0" * 50)
    tables = box(b"stsd", struct.pack(">II", 0, 1) + entry) + box(b"stts", struct.pack(">IIII", 0, 1, h, 1001))
    media_box = box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 24000, h * 1001, 0x15C7, 0)) + box(b"hdlr", struct.pack(">II", 0, 0) + b"vide" + b"\0" * 13) + box(b"minf", box(b"stbl", tables))
    return box(b"ftyp", b"isom\0\0\0\0isom") + box(b"moov", box(b"trak", box(b"mdia", media_box)))


def q_mp4_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_packed(_parts(spark, sf_dir), build_mp4), "Video", "CodecID", "Width", "Height", "FrameCount", "FrameRate", "Language")


def q_media_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of eight formats in one table, told apart by their bytes."""
    builders = [build_png, build_gif, build_bmp, build_wave, build_au, build_aiff, build_flac, build_mp4]
    rows = _parts(spark, sf_dir).withColumn("k", (F.col("p_partkey") % 8).cast("int"))
    files = _packed(rows, lambda w, h, k: builders[k](w, h))
    return media.stream_rows(files).filter("kind = 'General'").select("file", "format", "score", F.element_at("fields", "FileSize").cast("long").alias("size"))


def q_probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages and documents as files: texts that no format takes keep their General row alone."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file"), F.to_binary("html", F.lit("utf-8")).alias("content"))
    cue = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,500\n"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.to_binary(cue, F.lit("utf-8")).alias("content"))
    return media.stream_rows(pages.unionByName(docs)).groupBy("format", "kind").agg(F.count(F.lit(1)).alias("rows"))


def q_srt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subtitle file per user, a cue per event: counted, with the first begin and the last end."""
    ms = (F.col("event_id") * 7919) % 86_000_000
    part = lambda x, by, n: F.lpad((((x - x % by) / by).cast("long") % n).cast("string"), 2, "0")
    clock = lambda x: F.concat(F.concat_ws(":", part(x, 3_600_000, 100), part(x, 60_000, 60), part(x, 1000, 60)), F.lit(","), F.lpad((x % 1000).cast("string"), 3, "0"))
    cue = F.concat(clock(ms), F.lit(" --> "), clock(ms + 1500), F.lit("\ntext\n\n"))
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", cue.alias("cue")).alias("x"))
    files = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cue"]), "").alias("text")).select(F.col("user_id").cast("string").alias("file"), F.to_binary("text", F.lit("utf-8")).alias("content"))
    return _fields(files, "Text", "ElementCount", "Duration", "Delay")


def q_probe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by score, ties in the order of a registry: scores are given, the ranking is a window."""
    from pyspark.sql import Window

    registry = F.broadcast(spark.sql("SELECT * FROM VALUES (1, 'a', 100), (2, 'b', 60), (3, 'c', 60), (4, 'd', 20) AS t(place, name, base)"))
    scored = table(spark, sf_dir, "part").select("p_partkey", "p_size").crossJoin(registry).withColumn("score", F.when(F.col("p_size") % (F.col("place") + 1) == 0, F.col("base")).otherwise(0)).filter("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.col("score").desc(), "place"))).filter("rank = 1").select("p_partkey", "name", "score")


def q_ext_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = media.ext_score(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


def q_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big- and little-endian integers and syncsafe sizes read from bytes with built-in functions."""
    n = F.col("l_orderkey") % (1 << 28)
    raw = F.unhex(F.lpad(F.hex(n), 8, "0"))
    byte = lambda k: F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("long")
    safe = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, s).bitwiseAND(127)), 2, "0") for s in (21, 14, 7, 0))))
    part = lambda k: F.conv(F.hex(F.substring(safe, k, 1)), 16, 10).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.conv(F.hex(raw), 16, 10).cast("long").alias("big"), (byte(4) * (1 << 24) + byte(3) * (1 << 16) + byte(2) * 256 + byte(1)).alias("little"), (part(1) * (1 << 21) + part(2) * (1 << 14) + part(3) * 128 + part(4)).alias("syncsafe"))


QUERIES = {name: value for name, value in globals().items() if name.startswith("q_")}
_P = "WITH p AS (SELECT p_partkey::VARCHAR AS file, p_partkey AS k, p_size * 16 AS w, p_partkey % 1000 + 1 AS h FROM part)"
_IMAGE = lambda name, depth: f"{_P} SELECT file, '{name}' AS format, w::VARCHAR AS width, h::VARCHAR AS height, {depth} AS bitdepth FROM p"
_MS = "cast(floor({0} * 1000 / (w * 100)::DOUBLE + 0.5) AS BIGINT)::VARCHAR"
_SOUND = lambda name, duration: f"{_P} SELECT file, '{name}' AS format, '2' AS channels, (w * 100)::VARCHAR AS samplingrate, '16' AS bitdepth, {duration} AS duration FROM p"
_RATES = "[" + ", ".join(map(str, media.AAC_RATES)) + "]"
ORACLE = {
    "q_png_roundtrip": _IMAGE("PNG", "'32'"), "q_gif_roundtrip": _IMAGE("GIF", "NULL::VARCHAR"), "q_bmp_roundtrip": _IMAGE("Bitmap", "'24'"),
    "q_wav_roundtrip": _SOUND("Wave", _MS.format("h")), "q_au_roundtrip": _SOUND("AU", "cast(floor(4 * h * 8 * 1000 / (w * 3200)::DOUBLE + 0.5) AS BIGINT)::VARCHAR"),
    "q_aiff_roundtrip": _SOUND("AIFF", "printf('%.3f', h / (w * 100)::DOUBLE * 1000)"), "q_flac_roundtrip": _SOUND("FLAC", _MS.format("h * 100")),
    "q_ivf_roundtrip": f"{_P} SELECT file, 'IVF' AS format, 'VP90' AS codecid, w::VARCHAR AS width, h::VARCHAR AS height, (h % 20 + 1)::VARCHAR AS framecount, ((h % 20 + 1) * 40)::VARCHAR AS duration FROM p",
    "q_adts_roundtrip": f"{_P} SELECT file, 'ADTS' AS format, '2' AS channels, {_RATES}[w // 16 % 13 + 1]::VARCHAR AS samplingrate, '3' AS framecount FROM p",
    "q_mp3_header": f"{_P} SELECT file, 'MPEG Audio' AS format, 'Layer 3' AS format_profile, '44100' AS samplingrate, ([{', '.join(map(str, media.MPEG_RATES[(1, 3)]))}][w // 16 % 14 + 2] * 1000)::VARCHAR AS bitrate, '3' AS framecount FROM p",
    "q_ac3_header": f"{_P} SELECT file, 'AC-3' AS format, '2' AS channels, ([{', '.join(map(str, media.AC3_KBITS))}][w // 16 % 19 + 1] * 1000)::VARCHAR AS bitrate, '96' AS duration FROM p",
    "q_mp4_boxes": f"{_P} SELECT file, 'MPEG-4' AS format, 'avc1' AS codecid, w::VARCHAR AS width, h::VARCHAR AS height, h::VARCHAR AS framecount, '23.976' AS framerate, 'eng' AS language FROM p",
    "q_media_roundtrip": f"{_P} SELECT file, ['PNG', 'GIF', 'Bitmap', 'Wave', 'AU', 'AIFF', 'FLAC', 'MPEG-4'][k % 8 + 1] AS format, 100 AS score, [33, 13, 180, 44 + 4 * h, 28, 38, 42, {len(build_mp4(16, 1))}][k % 8 + 1]::BIGINT AS size FROM p",
    "q_probe_files": "SELECT * FROM (VALUES ('SubRip', 'General'), ('SubRip', 'Text')) AS v(format, kind), (SELECT count(*) AS rows FROM documents) UNION ALL SELECT NULL, 'General', count(*) FROM pages",
    "q_srt_stats": "WITH t AS (SELECT user_id, event_id * 7919 % 86000000 AS ms FROM events) SELECT user_id::VARCHAR AS file, 'SubRip' AS format, count(*)::VARCHAR AS elementcount, max(ms + 1500)::VARCHAR AS duration, min(ms)::VARCHAR AS delay FROM t GROUP BY user_id",
    "q_probe_rank": "WITH r AS (SELECT * FROM (VALUES (1, 'a', 100), (2, 'b', 60), (3, 'c', 60), (4, 'd', 20)) AS v(place, name, base)), s AS (SELECT p_partkey, name, base AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY base DESC, place) AS n FROM part, r WHERE p_size % (place + 1) = 0) SELECT p_partkey, name, score FROM s WHERE n = 1",
    "q_ext_score": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 90 WHEN p_partkey % 2 = 0 THEN 60 WHEN p_partkey % 3 = 0 THEN 20 ELSE 0 END AS score FROM part",
    "q_integers": "WITH t AS (SELECT l_orderkey, l_orderkey % 268435456 AS n FROM lineitem) SELECT l_orderkey, n AS big, (n % 256) * 16777216 + (n // 256 % 256) * 65536 + (n // 65536 % 256) * 256 + n // 16777216 AS little, n AS syncsafe FROM t",
}
