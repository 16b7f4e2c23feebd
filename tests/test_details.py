"""Duration tags, compression, dumps and totals."""

import random

from pyspark.sql import functions as F

from reelframe.functions.formatters import compression_ratio
from reelframe.functions.text import hms_to_ms
from reelframe.operators import dumps, estimate


def test_duration_tags_and_compression(spark):
    rows = spark.createDataFrame([("00:01:02.500000000",), (" 1:0:0 ",), ("1:2",), ("a:b:c",), (None,), ("1:2:3:4",)], "t string")
    assert [r.ms for r in rows.select(hms_to_ms(F.col("t")).alias("ms")).collect()] == [62500.0, 3600000.0, None, None, None, 3723000.0]
    rates = spark.createDataFrame([(705600.0,), (0.0,), (None,)], "r double").select(compression_ratio(F.lit(44100), F.lit(16), F.lit(2), F.col("r")).alias("x"))
    assert [r.x for r in rates.collect()] == ["2.000", None, None]


def test_dumps_are_read(spark):
    text = "early\tA\tx\n== Video #0 (2 fields)\n0\tFormat\tAVC\n1\tTitle\ta\\nb\textra\nodd line\n== Video #1\n0\tFormat\tx\n0\tFormat\ty\n== Menu\n"
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text.split("\n"))] + [("g", 0, None)], "file string, number int, line string")
    for width in (2, 100):
        assert sorted(tuple(r) for r in dumps.read(lines, width).collect()) == [("f", "Video", 0, "Format", "AVC"), ("f", "Video", 0, "Title", "a\nb"), ("f", "Video", 1, "Format", "y")]


def test_estimates_state_their_error(spark):
    r = random.Random(2)
    rows, at = [], 0
    while at < 4_000_000:
        size = r.randint(500, 3000)
        rows.append(("f", r.choice("aab"), at, size))
        at += size
    rows += [("g", "a", 0, 10), ("g", "a", 10, 20)]
    parts = spark.createDataFrame(rows, "file string, stream string, at long, size long")
    files = spark.createDataFrame([("f", at), ("g", 30)], "file string, bytes long")
    exact = {(x.file, x.stream): x for x in estimate.totals(parts, files).collect()}
    assert all(x.exact and x.packets == sum(y[:2] == k for y in rows) for k, x in exact.items())
    for x in estimate.totals(parts, files, bound=1_000_000).collect():
        true = exact[x.file, x.stream]
        assert x.exact == (x.file == "g") and (x.packets == true.packets if x.exact else abs(x.packets - true.packets) <= 2 * x.error and 0 < x.error < 0.2 * true.packets)
    assert all(x.error is None for x in estimate.totals(parts, files, bound=60_000).collect() if x.file == "f")
