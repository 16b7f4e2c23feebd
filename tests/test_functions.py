"""Values of the formatting, text and parsing functions at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from reelframe.functions import formatters, text
from reelframe.operators import fields, sequences
from reelframe.plans import media as builders
from reelframe.sources import media


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "want"), [(0, ["0.00 Byte", "0 Byte", "0.0 Byte", "0.00 Byte", "0.000 Byte"]), (1, ["1.00 Byte", "1 Byte", "1.0 Byte", "1.00 Byte", "1.000 Byte"]), (1023, ["1023 Bytes", "1023 Bytes", "1023 Bytes", "1023 Bytes", "1023 Bytes"]), (1536, ["1.50 KiB", "2 KiB", "1.5 KiB", "1.50 KiB", "1.500 KiB"]), (10 * 1024 - 1, ["10.0 KiB", "10 KiB", "10 KiB", "10.0 KiB", "9.999 KiB"]), (2560, ["2.50 KiB", "2 KiB", "2.5 KiB", "2.50 KiB", "2.500 KiB"])])
def test_size_strings(spark, n, want):
    assert value(spark, formatters.size_strings(F.lit(n))) == want


@pytest.mark.parametrize(("ms", "fps", "want"), [(0, None, ("0 ms", "0 ms", "00:00:00.000", "", "00:00:00.000")), (-61_001, None, ("-1 min 1 s 1 ms", "-1 min 1 s", "-00:01:01.001", "", "-00:01:01.001")), (3_600_500, 25.0, ("1 h 0 min 0 s 500 ms", "1 h 0 min", "01:00:00.500", "01:00:00:12", "01:00:00.500 (01:00:00:12)")), (360_000_000, None, ("100 h 0 min 0 s 0 ms", "100 h 0 min", "100:00:00.000", "", "100:00:00.000"))])
def test_duration_strings(spark, ms, fps, want):
    assert tuple(value(spark, formatters.duration_strings(F.lit(ms), None if fps is None else F.lit(fps)))) == want


@pytest.mark.parametrize(("v", "want"), [(9_999.0, "9 999 b/s"), (10_000.0, "10.0 kb/s"), (999_999.0, "1 000 kb/s"), (12_345_678.0, "12.3 Mb/s"), (10_500_000_000.0, "10.5 Gb/s"), (0.0, "0 b/s")])
def test_bitrate_string(spark, v, want):
    assert value(spark, formatters.bitrate_string(F.lit(v))) == want


@pytest.mark.parametrize(("v", "d", "want"), [(0.125, 2, "0.12"), (1.0005, 3, "1.000"), (9.995, 2, "9.99"), (0.0005, 3, "0.001")])
def test_fixed_rounds_the_binary_value(spark, v, d, want):
    assert value(spark, formatters.fixed(F.lit(v), d)) == want


def test_text_functions(spark):
    assert value(spark, text.extension(F.lit("a/b.c/.hidden"))) == "" and value(spark, text.extension(F.lit("x/Y.MKV"))) == "mkv"
    assert value(spark, text.channel_positions(F.lit("Front: L C R, Side: L R, LFE"))) == "3/2/0.1"
    assert value(spark, text.json_escape(F.lit('a"\\\n\x01é'))) == '"a\\"\\\\\\n\\u0001é"'
    assert value(spark, text.xml_escape(F.lit('<a b="c">&\x02'))) == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert value(spark, text.export_name(F.lit("Channel(s)/String"))) == "Channels_String" and value(spark, text.export_name(F.lit("3D"))) == "_3D"
    assert value(spark, text.ms_to_seconds(F.lit("1234.5"))) == "1.2345" and value(spark, text.ms_to_seconds(F.lit("x"))) == "x"
    assert value(spark, text.clock_to_ms(F.lit("00:60:00,000"), text.SRT_TIME)) is None and value(spark, text.clock_to_ms(F.lit("01:02.003"), text.VTT_TIME)) == 62_003
    assert value(spark, fields.template("%a%$if(%b%,x%b%,none)%", {"a": F.lit("1"), "b": F.lit(None).cast("string")})) == "1none%"


def test_as_of_before_any_run(spark):
    chunks = spark.createDataFrame([(1, 1), (1, 5), (1, 9)], "k long, c long")
    runs = spark.createDataFrame([(1, 5, "a"), (1, 8, "b"), (2, 0, "z")], "k long, f long, v string")
    assert {r.c: r.v for r in sequences.as_of(chunks, runs, "k", "c", "f", "v").collect()} == {1: None, 5: "a", 9: "b"}


BUILDERS = [builders.build_png, builders.build_gif, builders.build_bmp, builders.build_wave, builders.build_au, builders.build_aiff, builders.build_flac, builders.build_ivf, builders.build_adts, builders.build_mp3, builders.build_ac3, builders.build_mp4]


@pytest.mark.parametrize("build", BUILDERS)
def test_truncated_and_flipped_files_never_fail(build):
    data = build(320, 40)
    for cut in [*range(0, min(len(data), 64)), len(data) // 2]:
        media.parsed("x.bin", data[:cut])
    r = random.Random(9)
    for flips in (1, 5, 9, 13, 17, 21):
        bad = bytearray(data)
        for _ in range(flips):
            bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        media.parsed("x.bin", bytes(bad))


def element(name, body):
    size = len(body)
    return name + (0x4000 | size).to_bytes(2, "big") + body


def test_matroska_and_ogg_and_flv_and_avi():
    import struct

    track = element(b"\xae", element(b"\x83", b"\1") + element(b"\x86", b"V_VP9") + element(b"\xe0", element(b"\xb0", b"\x02\x80") + element(b"\xba", b"\x01\x68")))
    info = element(b"\x15\x49\xa9\x66", element(b"\x2a\xd7\xb1", b"\x0f\x42\x40") + element(b"\x44\x89", struct.pack(">f", 1500)))
    file = element(b"\x1a\x45\xdf\xa3", b"") + element(b"\x18\x53\x80\x67", info + element(b"\x16\x54\xae\x6b", track))
    name, score, streams = media.parsed("a.mkv", file)
    assert (name, score) == ("Matroska", 100) and streams[0][1]["Duration"] == 1500 and streams[1][1]["Width"] == 640
    head = b"OpusHead\1\2" + b"\0" * 9
    page = lambda flags, granule, body: b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, 7, 0, 0) + bytes([1, len(body)]) + body
    assert media.parsed("a.ogg", page(2, 0, head) + page(0, 48000, b"x"))[2][1][1]["Duration"] == 1000
    tag = lambda kind, time, body: bytes([kind]) + len(body).to_bytes(3, "big") + time.to_bytes(3, "big") + b"\0\0\0\0" + body + b"\0\0\0\0"
    flv = b"FLV\1\1\0\0\0\x09\0\0\0\0" + b"".join(tag(9, 40 * k, b"\x17xx") for k in range(5))
    assert media.parsed("a.flv", flv)[2][1][1] | {} == {"Format": "AVC", "Duration": 200, "FrameCount": 5, "FrameRate": "25.000"}


def test_files_are_parsed_beyond_eight_mebibytes():
    import struct

    from reelframe.plans import media as plans

    big = 9 << 20
    file = plans.build_mp4(320, 40)
    start = file.index(b"moov") - 4
    late = file[:start] + plans.box(b"mdat", bytes(big)) + file[start:]
    want, got = media.parsed("a.mp4", file), media.parsed("a.mp4", late)
    assert got[:2] == want[:2] and got[2][1:] == want[2][1:] and got[2][0][1]["FileSize"] == len(late)
    page = lambda flags, granule, body: b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, 7, 0, 0) + bytes([-(-len(body) // 255)]) + bytes([255] * (len(body) // 255) + ([len(body) % 255] if len(body) % 255 else [])) + body
    pages = page(2, 0, b"OpusHead\1\2" + b"\0" * 9) + b"".join(page(0, 480 * k, bytes(60_000)) for k in range(1, 160))
    assert len(pages) > big and media.parsed("a.ogg", pages)[2][1][1]["Duration"] == 10 * 159
    tag = lambda time, body: bytes([9]) + len(body).to_bytes(3, "big") + time.to_bytes(3, "big") + b"\0\0\0\0" + body + b"\0\0\0\0"
    flv = b"FLV\1\1\0\0\0\x09\0\0\0\0" + b"".join(tag(40 * k, b"\x17" + bytes(100_000)) for k in range(100))
    assert media.parsed("a.flv", flv)[2][1][1]["FrameCount"] == 100
    cue = "1\n00:00:01,000 --> 00:00:02,500\n" + "x" * 1000 + "\n\n"
    assert media.parsed("a.srt", (cue * 10_000).encode())[2][1][1]["ElementCount"] == 10_000


def test_subtitles_and_unknown_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nhi\n\n2\n00:00:05,000 --> 00:00:04,000\nno\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhi\n")
    (tmp_path / "c.ass").write_text("[Script Info]\nScriptType: v4.00+\n[Events]\nDialogue: 0,0:00:01.50,0:00:03.00,x\n")
    (tmp_path / "d.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "e.idx").write_text("# VobSub index file\nsize: 720x576\nid: en, index: 0\ntimestamp: 00:00:01:500, filepos: 0\n")
    got = {r.file[-5:]: (r.format, r.fields) for r in media.read_files(spark, str(tmp_path)).filter("kind = 'Text' OR format IS NULL").collect()}
    assert got["a.srt"][1]["ElementCount"] == "1" and got["b.vtt"][1]["Duration"] == "2000" and got["c.ass"][1]["Delay"] == "1500" and got["e.idx"][1]["Language"] == "en"
    assert got["d.bin"] == (None, {"FileSize": "3", "StreamSize": "3"})


def test_timecodes_of_more_than_99_hours(spark):
    frame = spark.createDataFrame([(90_000 * 100 + 26,), (90_000 * 1234,), (24,)], "n long")
    from reelframe.functions.text import timecode

    assert [r[0] for r in frame.select(timecode(F.col("n"), 25)).collect()] == ["100:00:01:01", "1234:00:00:00", "00:00:00:24"]


def test_reports_of_columns_and_rows_agree_without_a_join(spark):
    rows = [("f", 1, "Video", 1, "a<b", '"q"\x01'), ("f", 1, "Video", 3, "", None), ("f", 1, "Video", 4, "c&", ""), ("f", 2, "Audio", 2, None, "\tt\\"), ("g", 3, "Text", 1, "", "")]
    wide = spark.createDataFrame(rows, "file string, kind_id int, kind string, idx int, a string, b string")
    long = fields.to_rows(wide, ["file", "kind_id", "kind", "idx"], ["a", "b"])
    for report in (fields.text_report, fields.xml_report, fields.json_report, lambda *x, **y: fields.xml_report(*x, old=True, **y)):
        mine, other = report(wide, fields=["a", "b"]), report(long)
        assert mine.collect() == other.collect() and len(mine.collect()) == 1
        assert "Join" not in mine._jdf.queryExecution().executedPlan().toString()
    assert fields.text_report(wide, fields=["a"]).first()[1] == "Video #1\n" + "a".ljust(41) + ": a<b\n\nVideo #2\n" + "a".ljust(41) + ": c&\n\n"
    assert "&lt;" in fields.xml_report(long).first()[1] and "\x01" not in fields.xml_report(long).first()[1] and "\\u0001" in fields.json_report(long).first()[1]
