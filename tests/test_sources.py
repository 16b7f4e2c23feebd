"""Tags, bits and the added formats: what is written is read again."""

import re
import struct

import pytest
from pyspark.sql import functions as F

from reelframe.sources import bits, media, more, tags


def comment(items, vendor=b"lib 1"):
    body = struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(items))
    return body + b"".join(struct.pack("<I", len(x)) + x for x in (f"{k}={v}".encode() for k, v in items))


def frame(name, text, kind=3):
    body = bytes([kind]) + text
    return name + struct.pack(">I", len(body)) + b"\0\0" + body


def id3(*frames):
    body = b"".join(frames)
    return b"ID3\3\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body


def test_windows_and_bits():
    w = bits.Window(bytes(range(256)) * 5000)
    assert w.integer(2) == 1 and w.read(2) == b"\2\3" and w.peek(1) == b"\4"
    w.seek(w.size - 1)
    assert w.read_exact(2) is None and w.read(9) == b"\xff" and w.window(700_000, 2) == bytes([700_000 % 256, 700_001 % 256])
    r = bits.Bits(bytes([0b10100110, 0b01100100]))
    assert [r.ue(), r.ue(), r.ue()] == [0, 1, 2] and r.left == 9
    assert [bits.Bits(bytes([x])).se() for x in (0b01000000, 0b01100000)] == [1, -1]
    with pytest.raises(EOFError):
        bits.Bits(b"").bits(1)
    assert bits.unescaped(b"\0\0\3\1\0\0\3\0\0\3") == b"\0\0\1\0\0\0\0"
    assert bits.utf16(b"\xff\xfea\0") == "a" and bits.latin1(b"\xe9\0x") == "é" and bits.clean(" \x01a\tb\n") == "a\tb"


def test_vorbis_comments_of_flac():
    block = comment([("title", "One"), ("TRACKNUMBER", "3"), ("REPLAYGAIN_TRACK_GAIN", "-3.5 dB"), ("Odd", "x"), ("TITLE", "Two")])
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + (44100 << 44 | 1 << 41 | 15 << 36 | 44100).to_bytes(8, "big") + b"\0" * 16
    data = b"fLaC\0\0\0\x22" + info + b"\x84" + len(block).to_bytes(3, "big") + block + b"\0" * 100
    name, score, streams = media.parsed("a.flac", id3(frame(b"TALB", b"Both")) + data)
    general, sound = streams[0][1], streams[1][1]
    assert (name, general["Title"], general["Track"], general["Track/Position"], general["ReplayGain_Gain"], general["ODD"], general["Album"]) == ("FLAC", "One", "One", "3", "-3.5", "x", "Both")
    assert sound["Encoded_Library"] == "lib 1" and sound["Duration"] == 1000 and sound["BitRate"] == 800


def test_id3_and_ape_tags():
    got, size = tags.id3v2(id3(frame(b"TIT2", "Né".encode()), frame(b"TRCK", b"3/12"), frame(b"TCON", b"(17)"), frame(b"COMM", b"eng\0note"), frame(b"TPE1", b"\xff\xfeA\0", 1), frame(b"TXXX", b"Key\0Value")))
    assert got == {"Title": "Né", "Track": "Né", "Track/Position": "3", "Track/Position_Total": "12", "Genre": "Rock", "Comment": "note", "Performer": "A", "Key": "Value"} and size > 10
    old = b"TAG" + b"T".ljust(30, b"\0") + b"P".ljust(30, b"\0") + b"A".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\7" + b"\x08"
    assert tags.id3v1(b"x" * 50 + old) == {"Title": "T", "Track": "T", "Performer": "P", "Album": "A", "Recorded_Date": "1999", "Comment": "c", "Track/Position": 7, "Genre": "Jazz"}
    items = b"".join(struct.pack("<II", len(v), 0) + k + b"\0" + v for k, v in ((b"Title", b"X"), (b"Track", b"2/9"), (b"My", b"y")))
    foot = b"APETAGEX" + struct.pack("<III", 2000, len(items) + 32, 3) + b"\0" * 12
    assert tags.apev2(b"sound" + items + foot + old) == {"Title": "X", "Track/Position": "2", "Track/Position_Total": "9", "My": "y"}
    assert [tags.genre_name(x) for x in ("(8)", "8", "(4)Own", "Free", "(200)")] == ["Jazz", "Jazz", "Own", "Free", "(200)"]


def box(name, body):
    return struct.pack(">I", len(body) + 8) + name + body


def test_items_behind_a_large_mdat():
    value = lambda kind, x: box(b"data", struct.pack(">II", kind, 0) + x)
    free = box(b"----", box(b"mean", b"\0\0\0\0com.x") + box(b"name", b"\0\0\0\0Own") + value(1, b"v"))
    ilst = box(b"ilst", box(b"\xa9nam", value(1, b"Name")) + box(b"trkn", value(0, b"\0\0\0\3\0\x0c\0\0")) + box(b"cpil", value(21, b"\1")) + free)
    moov = box(b"moov", box(b"udta", box(b"meta", b"\0\0\0\0" + ilst)))
    name, _, streams = media.parsed("a.mp4", box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"\0" * (9 << 20)) + moov)
    assert name == "MPEG-4" and {k: v for k, v in streams[0][1].items() if k not in ("Format", "FileSize")} == {"Title": "Name", "Movie": "Name", "Track/Position": "3", "Track/Position_Total": "12", "Compilation": "Yes", "Own": "v"}


def write(*fields):
    """Bits of (value, width) or Exp-Golomb numbers (value, 'u')."""
    out = ""
    for v, n in fields:
        out += f"{v:0{n}b}" if n != "u" else "0" * ((v + 1).bit_length() - 1) + f"{v + 1:b}"
    out += "1" + "0" * (-(len(out) + 1) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def test_avc_and_hevc_parameter_sets():
    sps = b"\x67" + write((100, 8), (0, 8), (41, 8), (0, "u"), (1, "u"), (2, "u"), (2, "u"), (0, 1), (0, 1), (0, "u"), (0, "u"), (0, "u"), (4, "u"), (0, 1), (119, "u"), (67, "u"), (1, 1), (1, 1), (1, 1), (0, "u"), (0, "u"), (0, "u"), (4, "u"), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), (1, 1), (1, 32), (50, 32), (1, 1))
    data = b"\0\0\0\1" + re.sub(rb"\x00\x00(?=[\x00-\x03])", b"\0\0\3", sps) + b"\0\0\1\x68\xce\x38\x80\0\0\1\x65\x88"
    name, score, streams = media.parsed("x.264", data)
    assert (name, score) == ("AVC", 95)
    assert streams[1][1] == {"Format": "AVC", "Format_Profile": "High@L4.1", "Width": 1920, "Height": 1080, "ChromaSubsampling": "4:2:0", "BitDepth": 10, "Format_Settings_RefFrames": 4, "ScanType": "Progressive", "FrameRate": "25.000"}
    sps = b"\x42\1" + write((0, 4), (0, 3), (1, 1), (0, 2), (0, 1), (2, 5), (0, 32), (0, 48), (120, 8), (0, "u"), (1, "u"), (1280, "u"), (720, "u"), (0, 1), (2, "u"), (2, "u"))
    name, _, streams = media.parsed("x.bin", b"\0\0\0\1\x40\1\x0c\0\0\1" + sps.replace(b"\0\0\0", b"\0\0\3\0") + b"\0\0\1\x44\1\xc0")
    assert name == "HEVC" and (streams[1][1]["Width"], streams[1][1]["Height"], streams[1][1]["BitDepth"], streams[1][1]["Format_Profile"]) == (1280, 720, 10, "Main 10@L4@Main")


def test_transport_and_program_streams():
    packet = lambda pid, body, head=b"": b"\x47" + struct.pack(">H", 0x4000 | pid) + (b"\x30" + head if head else b"\x10") + body.ljust(184 - len(head), b"\xff")
    clock = lambda t: b"\7\x10" + (t << 15 | 0x7E00).to_bytes(6, "big")
    pat = b"\0\0\xb0\x0d\0\1\xc1\0\0\0\5\xe1\0" + b"\0" * 4
    pmt = b"\0\2\xb0\x17\0\5\xc1\0\0\xe1\1\xf0\0" + b"\x0f\xe1\2\xf0\0" + b"\x1b\xe1\1\xf0\0" + b"\0" * 4
    data = packet(0, pat) + packet(0x100, pmt) + b"".join(packet(0x101, b"", clock(90_000 * k)) for k in range(6))
    name, score, streams = media.parsed("a.ts", data)
    assert (name, score) == ("MPEG-TS", 100) and streams[0][1]["Duration"] == 5000
    assert [(k, f["ID"], f["Format"]) for k, f in streams[1:]] == [("Video", 0x101, "AVC"), ("Audio", 0x102, "AAC"), ("Menu", 5, "AAC / AVC")]
    stamp = lambda t: bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254])
    pes = lambda own, t: b"\0\0\1" + bytes([own]) + b"\0\x0a\x80\x80\5" + stamp(t) + b"\7" * 2
    name, _, streams = media.parsed("a.mpg", b"\0\0\1\xba" + b"\x44" * 10 + pes(0xC0, 90) + pes(0xE0, 900) + pes(0xC0, 9090))
    assert name == "MPEG-PS" and [(k, f["ID"], f["Delay"], f["Duration"]) for k, f in streams[1:]] == [("Video", 0xE0, 10, None), ("Audio", 0xC0, 1, 100)]


def test_other_formats():
    video = b"\0\0\1\xb3" + (720 << 12 | 576).to_bytes(3, "big") + b"\x33" + (1000 << 6).to_bytes(3, "big") + b"\0" + b"\0\0\1\xb5\x14\x8a\0\1\0\0" + b"\0\0\1\xb8\0\0\0\0" + b"\0\0\1\0\0\x0f\xff" * 2
    name, _, streams = media.parsed("a.m2v", video)
    assert name == "MPEG Video" and {"Format_Version": "Version 2", "Width": 720, "Height": 576, "FrameRate": "25.000", "DisplayAspectRatio": "1.778", "FrameCount": 2}.items() <= streams[1][1].items()
    name, _, streams = media.parsed("a.wv", b"wvpk" + struct.pack("<IHBBIIIII", 100, 0x410, 0, 0, 96000, 0, 0, 10 << 23 | 1, 0))
    assert name == "WavPack" and (streams[1][1]["Duration"], streams[1][1]["BitDepth"], streams[1][1]["SamplingRate"]) == (2000, 16, 48000)
    head = b"MAC " + struct.pack("<HHI", 3990, 0, 52) + b"\0" * 40
    name, _, streams = media.parsed("a.ape", head + struct.pack("<HHIIIHHI", 2000, 0, 44100, 44100, 3, 16, 2, 44100))
    assert name == "Monkey's Audio" and streams[1][1]["Duration"] == 3000
    props = b"\0" * 40 + struct.pack("<Q", 60_000_000) + b"\0" * 8 + struct.pack("<Q", 1000) + b"\0" * 12 + struct.pack("<I", 9000)
    thing = lambda guid, body: guid + struct.pack("<Q", len(body) + 24) + body
    sound = more.ASF_AUDIO + b"\0" * 32 + struct.pack("<H", 1) + b"\0" * 4 + struct.pack("<HHIIHH", 0x161, 2, 44100, 16000, 1, 16)
    text = thing(more.ASF_CONTENT, struct.pack("<5H", 4, 0, 0, 0, 0) + "Hi".encode("utf-16-le"))
    body = thing(more.ASF_FILE, props) + thing(more.ASF_STREAM, sound) + text
    name, _, streams = media.parsed("a.wma", more.ASF_HEADER + struct.pack("<QIBB", len(body) + 30, 3, 1, 2) + body)
    assert name == "ASF" and (streams[0][1]["Duration"], streams[0][1]["Title"], streams[1][1]["Format"], streams[1][1]["BitRate"]) == (5000, "Hi", "WMA", 128000)
    size = b"\xff\x4f\xff\x51\0\x2f\0\0" + struct.pack(">IIII", 640, 480, 0, 0) + b"\0" * 16 + b"\0\3\7\1\1"
    name, _, streams = media.parsed("a.jp2", b"\0\0\0\x0cjP  \r\n\x87\n" + size)
    assert name == "JPEG 2000" and (streams[1][1]["Width"], streams[1][1]["Height"], streams[1][1]["BitDepth"]) == (640, 480, 8)
    assert media.parsed("a.mxf", more.MXF_KEY + b"\1\2\4\0")[0] == "MXF" and media.parsed("a", more.NUT_HEAD)[0] == "Nut"


def test_damaged_heads_never_raise():
    import random

    r = random.Random(4)
    for head in (b"\x1a\x45\xdf\xa3", b"fLaC\0\0\0\x22", b"OggS\0\2", b".RMF\0\0\0\x12", more.ASF_HEADER, b"\0\0\1\xb3", b"\0\0\0\1\x67", b"\0\0\0\1\x42\1", b"MAC ", b"wvpk", b"\x7f\xfe\x80\x01", b"ID3\3\0\0\0\0\1\0", b"RIFF\0\0\0\0WAVELIST", b"\x47" + b"\0" * 187):
        for _ in range(60):
            media.parsed("x", head * r.choice((1, 8)) + bytes(r.getrandbits(8) for _ in range(r.randrange(300))))


def test_files_are_listed_and_streamed(spark, tmp_path):
    from reelframe.plans.media import build_gif, build_png
    from reelframe.streaming import read_stream

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "b.png").write_bytes(build_png(640, 480))
    (tmp_path / "in" / "deep" / "a.gif").write_bytes(build_gif(10, 20))
    listed = media.list_files(spark, str(tmp_path / "in"), recursive=True).collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["b.png", "a.gif"] and listed[1].size == 13 and listed[0].modified.startswith("UTC 2")
    assert media.list_files(spark, str(tmp_path / "in")).count() == 1
    query = read_stream(spark, str(tmp_path / "in"), recursive=True).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).filter("kind = 'Image'").collect()
    assert {(r.format, r.fields["Width"]) for r in rows} == {("PNG", "640"), ("GIF", "10")}


def test_built_files_are_dealt_out(spark, tmp_path):
    """A table in a single file is still many tasks' work."""
    from reelframe.plans import media as plans

    spark.range(1, 401).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for query in (plans.q_mp3_header, plans.q_mp4_boxes):
        got = query(spark, str(tmp_path))
        assert got.count() == 400
        assert got.select("file", F.spark_partition_id().alias("task")).groupBy("task").count().count() > 1
