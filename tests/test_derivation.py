"""The derivation pass: exact decimals, rules that wait for others, streams without values, and what a file gets from its streams."""

import random

from pyspark.sql import functions as F

from reelframe.operators import derive as op

SCHEMA = "file string, kind string, idx int, fields map<string,string>"


def test_decimals_round_the_exact_value(spark):
    r = random.Random(1)
    values = [r.random() * 10 ** r.randint(-4, 8) for _ in range(300)] + [k / 1000 + 0.0005 for k in range(500)] + [0.0005, 2.675, 1.005, 0.125, 0.375, 10.05, 2.5, 3.5, 0.0, 123456.7895]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 2, 3, 5):
        got = frame.select("v", op.plain(F.col("v"), k).alias("a"), op.decimals(F.col("v"), k).alias("b")).collect()
        assert all(x.a == f"{x.v:.{k}f}" and x.b == f"{x.v:,.{k}f}".replace(",", " ") for x in got)


def test_rules_wait_for_what_they_read(spark):
    frame = spark.createDataFrame([("f", "Video", 0, {"a": "2"}), ("f", "Audio", 0, {"a": "x"}), ("f", "Video", 1, {"b": "9", "a": ""})], SCHEMA)
    rules = [op.Rule("b", ("a",), lambda a: op.whole(a + 1)), op.Rule("c", ("b",), lambda b: op.whole(b * 10), ("Video",)), op.Rule("d", ("a",), lambda a: a, (), False)]
    got = {(r.kind, r.idx): {k: v for k, v in r.fields.items() if v} for r in op.phased(frame, rules).collect()}
    assert got == {("Video", 0): {"a": "2", "b": "3", "c": "30", "d": "2"}, ("Audio", 0): {"a": "x", "d": "x"}, ("Video", 1): {"b": "9", "c": "90"}}


def test_files_get_what_their_streams_tell(spark):
    rows = [
        ("f", "General", 0, {"Format": "Matroska", "FileSize": "1000000", "FileExtension": "AVI"}), ("f", "Video", 0, {"Format": "AVC", "Width": "720", "Height": "576", "FrameRate": "25.000", "FrameCount": "250", "StreamSize": "600000", "BitRate_Mode": "CBR"}),
        ("f", "Audio", 0, {"Format": "AAC", "Duration": "9000.4", "StreamSize": "100000", "BitRate_Mode": "VBR", "Language/String": "English", "CodecID": "55"}), ("f", "Audio", 1, None),
        ("g", "General", 0, {"Format": "FLAC", "FileSize": "50"}), ("h", "General", 0, {"Format": "AC-3"}), ("h", "Audio", 0, {"Format": "AC-3", "Encoded_Library": "x - 1"}),
    ]
    got = {(r.file, r.kind, r.idx): {k: v for k, v in r.fields.items() if v} for r in op.derived(spark.createDataFrame(rows, SCHEMA)).collect()}
    f = got["f", "General", 0]
    assert (f["Duration"], f["OverallBitRate"], f["OverallBitRate_Mode"], f["VideoCount"], f["AudioCount"]) == ("10000", "800000", "VBR", "1", "2")
    assert (f["Audio_Format_List"], f["Audio_Language_List"], f["FrameRate"], f["FrameCount"], f["FileExtension_Invalid"]) == ("AAC / ", "English / ", "25.000", "250", f["Format/Extensions"])
    assert "StreamSize" not in f and f["Duration/String"] == "10 s 0 ms" and f["FileSize/String"] == "977 KiB"
    video = got["f", "Video", 0]
    assert (video["Duration"], video["BitRate"], video["DisplayAspectRatio"], video["StreamSize/String"], video["StreamSize_Proportion"]) == ("10000", "480000", "1.250", "586 KiB (60%)", "0.60000")
    assert got["f", "Audio", 1]["StreamKindPos"] == "2" and "StreamKindPos" not in video and "Duration" not in got["g", "General", 0]
    assert got["h", "General", 0]["Encoded_Library_Name"] == "x" and got["h", "General", 0]["Encoded_Library_Version"] == "1"
    assert op.derived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_derived_queries_build_no_maps(spark):
    from reelframe.plans import derivation

    for name in ("q_derive_audio", "q_derive_video", "q_derive_words", "q_derive_names", "q_derive_bit_rate_lists"):
        plan = derivation.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "map_from_entries" not in plan and "map_concat" not in plan and "ArrowEval" not in plan, name


def test_layouts_agree(spark):
    r = random.Random(5)
    pools = {
        "Format": ["AVC", "FLAC", "MPEG Video", ""], "CodecID": ["55", "x"], "Format_Version": ["Version 2", "2"], "UniqueID": ["255", "z"], "Width": ["640", "0", "x"], "Height": ["480", "0"], "FrameRate": ["25.000", "-1"], "Duration": ["9000.4", "0", "x", "61234"],
        "FrameCount": ["250"], "StreamSize": ["600000", "123456789", ""], "BitRate": ["128000", "99960000 / x / 12"], "SamplingRate": ["48000", "8000"], "SamplesPerFrame": ["1024", "0"], "Delay": ["0", "-40"], "DisplayAspectRatio": ["1.778", "1.9"], "FileSize": ["7000000"],
        "BitRate_Mode": ["CBR", "x"], "Channel(s)": ["1", "6"], "ReplayGain_Gain": ["-3.5"], "Format_Settings_GMC": ["0", "2"], "Encoded_Library": ["a - b - c", "plain"], "Encoded_Library_Name": ["own"], "Interleave_Duration": ["5"], "ScanOrder": ["TFF"], "BitDepth": ["8"],
    }
    rows = [(str(k), r.choice(["Video", "Audio", "General", "Image"]), 0, {n: r.choice(v) for n, v in pools.items() if r.random() < 0.7}) for k in range(60)]
    maps = spark.createDataFrame(rows, SCHEMA).withColumn("file_size", F.lit(650000).cast("long"))
    whole = {x.file: {k: v for k, v in x.fields.items() if v} for x in op.with_values(op.with_names(maps)).collect()}
    wanted = sorted({n for x in whole.values() for n in x})
    wide = maps.select("file", "kind", "idx", "file_size", *(F.element_at("fields", F.lit(n)).alias(op.COLUMN + n) for n in pools))
    got = op.value_columns(op.name_columns(wide), wanted)
    mine = {x["file"]: {n: x[op.COLUMN + n] for n in wanted if x[op.COLUMN + n]} for x in got.collect()}
    assert mine == whole and len(wanted) > 60


def test_bit_rates_whose_rounding_adds_a_digit(spark):
    frame = spark.createDataFrame([("99960000 / 999600000 / 12000000000",)], "t string")
    row = frame.select(op.bit_rate_text(F.col("t")).alias("a"), op.bit_rate_text(F.col("t"), settled=False, units=2).alias("b")).first()
    assert row.a == "100 Mb/s / 1 000 Mb/s / 12.0 Gb/s" and row.b == "100.0 Mb/s / 1000 Mb/s / 12 000 Mb/s"
