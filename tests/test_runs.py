"""Runs, clocks and assignments against exploded or sequential plain Python, with blocks of a few rows."""

import math
import random

import pytest

from reelframe.operators import assign, blocks, clocks, runs


def test_running_and_lookups_over_blocks(spark):
    r = random.Random(1)
    rows = [(f, k, r.choice([None, 0, 3, 7])) for f in "ab" for k in range(37) if r.random() < 0.8]
    frame = spark.createDataFrame(rows, "file string, number long, v long")
    from pyspark.sql import functions as F

    for width in (1, 4, 1000):
        got = {(x.file, x.number): x.s for x in blocks.running(frame, ["file"], "number", {"s": F.col("v")}, width).collect()}
        assert got == {(f, k): sum(v or 0 for g, j, v in rows if g == f and j < k) for f, k, _ in rows}
    at = [(f, k, k // 3 * 2) for f in "ab" for k in range(20)]
    points = [(f, p) for f in "abc" for p in range(-1, 16)]
    frame, asked = spark.createDataFrame(at, "file string, number long, at long"), spark.createDataFrame(points, "file string, p long")
    for width in (1, 5, 1000):
        got = sorted((x.file, x.p, x.found and x.found.number) for x in blocks.last_before(asked, frame, ["file"], "p", "at", "number", ["number"], width).collect())
        assert got == sorted((f, p, max((k for g, k, t in at if g == f and t < p), default=None)) for f, p in points)


@pytest.mark.parametrize("width", [1, 3, 1 << 14])
def test_windows_equal_exploded_samples(spark, width):
    r = random.Random(width)
    times = [(f, k, r.choice([0, 1, 2, 9, None]), r.choice([0, 1, 10, 33])) for f in "abc" for k in range(9)]
    sizes = [(f, k, r.choice([0, 1, 5]), r.choice([0, 7, 100, None])) for f in "ab" for k in range(11)]
    windows = [(f, k, float(r.choice([-5, 0, 10, 15, 40])), float(r.choice([0, 1, 25, 1000, 10**7]))) for f in "abcd" for k in range(12)]
    scales = [("a", 1000), ("b", 90), ("d", 7)]
    got = runs.within(
        spark.createDataFrame(windows, "file string, window int, start double, length double"), spark.createDataFrame(times, "file string, run int, n int, delta int"),
        spark.createDataFrame(sizes, "file string, run int, n int, size int"), spark.createDataFrame(scales, "file string, timescale int"), width,
    )
    want = []
    for f, k, start, length in windows:
        scale, at, stamps = dict(scales).get(f, 1), 0, []
        for g, _, n, delta in times:
            for _ in range(n or 0) if g == f else ():
                stamps.append(at)
                at += delta
        size = [s or 0 for g, _, n, s in sizes for _ in range(n) if g == f]
        inside = [i for i, t in enumerate(stamps) if start - 0.001 <= t / scale * 1000 < start + length - 0.001]
        want.append((f, k, len(inside), sum(size[i] for i in inside if i < len(size))))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_totals_and_the_last_frame(spark):
    times = spark.createDataFrame([("a", 0, 9, 40), ("a", 1, 1, 30), ("b", 0, 9, 40), ("b", 1, 2, 30), ("c", 0, 1, 40)], "file string, run int, n int, delta int")
    sizes = spark.createDataFrame([("a", 0, 10, 100)], "file string, run int, n int, size int")
    assert sorted(tuple(x) for x in runs.totals(times, sizes).collect()) == [("a", 10, 390, 1000, -10), ("b", 11, 420, 0, None), ("c", 1, 40, 0, None)]


@pytest.mark.parametrize("width", [2, 5, 1 << 14])
def test_clocks_wrap_and_repeat(spark, width):
    period, rows, r = 1 << 33, [], random.Random(width)
    true = {}
    for f in "ab":
        time = 5
        for k in range(40):
            time += r.choice([0, 90_000, -3000, *[period // 5, period // 4 - 1] * 3])
            time = max(time, 0)
            true[f, k] = time
            rows.append((f, k, time % period if k % 9 != 4 else None, 188 * k))
    frame = spark.createDataFrame(rows, "file string, number long, clock long, at long")
    got = {(x.file, x.number): x.time for x in clocks.unwrapped(frame, width=width).collect()}
    base = {f: next(true[f, k] // period for g, k, c, _ in rows if g == f and c is not None) for f in "ab"}
    assert got == {(f, k): true[f, k] - base[f] * period for f, k, c, _ in rows if c is not None}
    assert max(true.values()) > 3 * period
    spans = {x.file: x for x in clocks.spans(frame, period, 90_000, width).collect()}
    for f in "ab":
        known = [(k, true[f, k]) for g, k, c, _ in rows if g == f and c is not None]
        assert math.isclose(spans[f].duration, (known[-1][1] - known[0][1]) / 90) and spans[f].bytes == 188 * (known[-1][0] - known[0][0])
        assert spans[f].repeated == sum(a[1] == b[1] for a, b in zip(known, known[1:]))
    rates = {(x.file, x.number): x.bit_rate for x in clocks.rates(frame, period, 90_000, width).collect()}
    for f in "ab":
        known = [(k, true[f, k]) for g, k, c, _ in rows if g == f and c is not None]
        assert all((rates[f, b[0]] is None) == (b[1] <= a[1]) for a, b in zip(known, known[1:]))


def test_assignments(spark):
    r = random.Random(9)
    make = lambda n, name: [(f, kind, r.choice(["x", "y", "z", "", None]), k) + ((f"{name}{k}",) if name else ()) for f in "abcd" for kind in ("v", "s") for k in range(n(f))]
    streams, entries = make(lambda f: {"a": 6, "b": 3, "c": 4, "d": 0}[f], ""), make(lambda f: {"a": 3, "b": 7, "c": 0, "d": 2}[f], "e")
    s, e = spark.createDataFrame(streams, "file string, kind string, key string, number int"), spark.createDataFrame(entries, "file string, kind string, key string, number int, text string")
    orderly, keyed = [], []
    for f, kind in sorted({x[:2] for x in streams}):
        own, free = [x for x in streams if x[:2] == (f, kind)], [x for x in entries if x[:2] == (f, kind)]
        left = list(free)
        for x in own:
            fits = next((y for y in left if y[2] == x[2] and x[2]), None)
            one = fits or next(iter(left), None)
            if one:
                left.remove(one)
            orderly.append((f, kind, x[3], one and one[4], fits is not None))
        left, rest = list(free), []
        for x in own:
            fits = next((y for y in left if y[2] == x[2] and x[2]), None)
            if fits:
                left.remove(fits)
                keyed.append((f, kind, x[3], fits[4], True))
            else:
                rest.append(x)
        keyed += [(f, kind, x[3], left[i][4] if i < len(left) else None, False) for i, x in enumerate(rest)]
    assert sorted((tuple(x) for x in assign.in_order(s, e, "text").collect()), key=repr) == sorted(orderly, key=repr)
    assert sorted((tuple(x) for x in assign.keyed_first(s, e, "text").collect()), key=repr) == sorted(keyed, key=repr)
