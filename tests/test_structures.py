"""Element trees: sizes of every kind, cut and odd input, continued lists, and the levels' bound."""

import struct

import pytest

from reelframe.operators import elements as op


def tree(spark, content, family, **more):
    frame = spark.createDataFrame([("f", content)] if not isinstance(content, list) else content, "file string, content binary")
    return sorted((tuple(r)[1:] for r in op.elements(frame, family, **more).collect()), key=lambda r: (r[4], r[2]))


def box(kind, payload=b""):
    return struct.pack(">I", 8 + len(payload)) + kind + payload


def test_boxes_of_every_size(spark):
    long = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    content = box(b"ftyp", b"isom") + long + box(b"moov", box(b"meta", b"\0\0\0\0" + box(b"ilst")) + box(b"tkhd", b"x")) + struct.pack(">I", 0) + b"mdat" + b"z" * 5
    got = tree(spark, content, op.BOXES)
    assert [(r[0], r[2], r[1], r[6]) for r in got] == [
        ("ftyp", "ftyp", 0, 12), ("free", "free", 0, 32), ("moov", "moov", 0, 69), ("moov/meta", "meta", 1, 60), ("moov/meta/ilst", "ilst", 2, 60), ("moov/tkhd", "tkhd", 1, 69), ("mdat", "mdat", 0, 82),
    ]
    assert [r[7] for r in got] == ["whole"] * 6 + ["open"]


def test_truncated_boxes(spark):
    inner = struct.pack(">I", 500) + b"trak" + box(b"tkhd", b"12")
    assert [(r[0], r[6], r[7]) for r in tree(spark, box(b"moov", inner), op.BOXES)] == [("moov", 26, "whole"), ("moov/trak", 26, "cut"), ("moov/trak/tkhd", 26, "whole")]
    assert tree(spark, b"\0\0\0\7abcdefgh", op.BOXES) == []  # smaller than its header
    assert tree(spark, b"\0\0\0\1abcd\0\0\0", op.BOXES) == []  # a 64-bit size that isn't there
    assert tree(spark, [("a", None), ("b", b""), ("c", b"1234567")], op.BOXES) == []
    huge = struct.pack(">I4sQ", 1, b"mdat", 2**64 - 1)
    assert [(r[0], r[6], r[7]) for r in tree(spark, huge + b"ab", op.BOXES)] == [("mdat", 18, "cut")]


def test_lists_longer_than_a_fold_go_on(spark):
    content = box(b"moov", b"".join(box(b"trak", box(b"tkhd")) for _ in range(23)) + box(b"udta")) + b"".join(box(b"free") for _ in range(9))
    whole = tree(spark, content, op.BOXES)
    assert whole == tree(spark, content, op.BOXES, most=4) and len(whole) == 1 + 46 + 1 + 9
    deep = tree(spark, content, op.BOXES, depth=2)
    assert {r[7] for r in deep if r[2] == "trak"} == {"deep"} and not any(r[2] == "tkhd" for r in deep)
    assert deep == tree(spark, content, op.BOXES, depth=2, most=3)


@pytest.mark.parametrize("family,order", [(op.CHUNKS, "<"), (op.BIG_CHUNKS, ">")])
def test_chunks_are_padded(spark, family, order):
    chunk = lambda kind, payload: kind + struct.pack(order + "I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    content = chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"INFO" + chunk(b"ISFT", b"abc") + chunk(b"IART", b"")) + chunk(b"data", b"x" * 7))
    assert [(r[0], r[5], r[6]) for r in tree(spark, content, family)] == [("RIFF", 8, 60), ("RIFF/LIST", 20, 44), ("RIFF/LIST/ISFT", 32, 35), ("RIFF/LIST/IART", 44, 44), ("RIFF/data", 52, 59)]


def test_ebml_sizes_and_unknown_ones(spark):
    cluster = bytes.fromhex("1F43B675FF") + bytes.fromhex("E78105") + bytes.fromhex("A34003") + b"xyz"
    content = bytes.fromhex("1A45DFA385") + bytes.fromhex("428282") + b"ab" + bytes.fromhex("1853806701FFFFFFFFFFFFFF") + cluster + cluster
    got = [(r[0], r[1], r[4], r[6], r[7]) for r in tree(spark, content, op.EBML)]
    assert got[:3] == [("1A45DFA3", 0, 0, 10, "whole"), ("1A45DFA3/4282", 1, 5, 10, "whole"), ("18538067", 0, 10, 50, "open")]
    assert [(x[0].split("/")[-1], x[4]) for x in got[3:]] == [("1F43B675", "open"), ("E7", "whole"), ("A3", "whole")] * 2
    assert tree(spark, b"\x00\x01", op.EBML) == [] and tree(spark, b"\xa3\x00", op.EBML) == [] and tree(spark, b"\xa3", op.EBML) == []
