"""Units in batch and as a stream, and windows of large files."""

import os
import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from reelframe.operators import demux
from reelframe.sources import windows
from reelframe.streaming.demux import ROCKS, unit_stream

SCHEMA = "file string, pid int, number long, counter int, start boolean, payload binary"


def packets(seed=4, files="ab", n=60):
    r, rows = random.Random(seed), []
    for f in files:
        counters = dict.fromkeys(range(3), 0)
        for k in range(n):
            pid = r.randrange(3)
            counters[pid] = (counters[pid] + r.choice([1] * 9 + [0, 5])) % 16
            row = (f, pid, 2 * k, counters[pid] if r.random() < 0.97 else None, r.random() < 0.3, r.randbytes(r.randint(0, 9)))
            rows.append(row)
            if r.random() < 0.2:
                rows.append((*row[:2], 2 * k + 1, *row[3:]))
    return rows


def units_plainly(rows):
    out = {}
    for key in sorted({x[:2] for x in rows}):
        before, units = None, []
        for _, _, number, counter, start, payload in sorted(x for x in rows if x[:2] == key):
            repeated = before is not None and before == (counter, payload)
            gap = before is not None and before[0] is not None and counter != (before[0] + 1) % 16
            before = (counter, payload)
            if not repeated:
                if start:
                    units.append([number, 0, 0, b""])
                if units:
                    units[-1] = [units[-1][0], units[-1][1] + 1, units[-1][2] + gap, units[-1][3] + payload]
        for k, u in enumerate(units):
            out[(*key, k + 1)] = (*u[:3], k + 1 < len(units), u[3])
    return out


def rows_of(found):
    return {(x.file, x.pid, x.unit): (x.first, x.packets, x.gaps, x.closed, bytes(x.data)) for x in found}


@pytest.mark.parametrize("width", [4, 1 << 14])
def test_units_equal_a_plain_reader(spark, width):
    rows = packets()
    frame = spark.createDataFrame(rows + [("a", 1, None, 1, True, b"x"), ("a", 1, 7, 1, True, None)], SCHEMA).repartition(3)
    assert rows_of(demux.units(frame, width).collect()) == units_plainly(rows)
    assert demux.units(frame.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch(spark, tmp_path, batches):
    rows = packets(seed=batches)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        ordered = sorted(rows, key=lambda x: x[2])
        size = -(-len(ordered) // batches)
        for k in range(batches):
            part = ordered[k * size : (k + 1) * size]
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1)
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = unit_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        got = rows_of(spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = rows_of(demux.units(spark.createDataFrame(rows, SCHEMA)).filter("closed").collect())
    assert got == batch and len(got) > 10


def test_windows_of_a_sparse_gigabyte(spark, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    with (folder / "large.bin").open("wb") as f:
        f.write(b"head")
        f.truncate(1 << 30)
        f.seek((1 << 30) - 4)
        f.write(b"tail")
    (folder / "small.bin").write_bytes(b"abc")
    (folder / "empty.bin").touch()
    (folder / "_hidden").write_bytes(b"x")
    (folder / "sub").mkdir()
    (folder / "sub" / "deep.bin").write_bytes(b"d" * 10)
    frame = windows.file_windows(spark, str(folder), head=4096, tail=4096, window=4096)
    got = {(os.path.basename(r.path), r.offset): bytes(r.bytes) for r in frame.collect()}
    assert {k: len(v) for k, v in got.items()} == {("large.bin", 0): 4096, ("large.bin", (1 << 30) - 4096): 4096, ("small.bin", 0): 3, ("empty.bin", 0): 0}
    assert got["large.bin", 0][:4] == b"head" and got["large.bin", (1 << 30) - 4096][-4:] == b"tail"
    assert windows.file_windows(spark, str(folder), recursive=True).count() == 4
    held = frame.filter((F.col("size") > 100) & (F.col("offset") > 0) & F.col("path").startswith(str(folder)))
    assert [r.offset for r in held.collect()] == [(1 << 30) - 4096]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").split("BatchScan")[0] or "isnotnull" in plan
    reader = windows.WindowReader({"path": str(folder / "large.bin"), "head": "-1", "window": str(1 << 20)})
    parts = reader.partitions()
    assert len(parts) == 128 and all(sum(w[3] for w in p.windows) <= 8 << 20 for p in parts)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(b.num_rows for b in reader.read(parts[0])) == 8
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 10 * 1024


def test_pushed_filters_choose_windows(tmp_path):
    (tmp_path / "a").write_bytes(bytes(1000))
    (tmp_path / "b").write_bytes(bytes(50))
    reader = windows.WindowReader({"path": str(tmp_path), "head": "-1", "window": "100"})
    known = [windows.EqualTo(("path",), str(tmp_path / "a")), windows.GreaterThanOrEqual(("offset",), 300), windows.LessThan(("offset",), 600), windows.EqualTo(("bytes",), b"")]
    assert list(reader.pushFilters(known)) == known[3:]
    assert [w[2] for p in reader.partitions() for w in p.windows] == [300, 400, 500]
    none = windows.WindowReader({"path": str(tmp_path)})
    assert list(none.pushFilters([windows.GreaterThan(("size",), 5000)])) == [] and [p.windows for p in none.partitions()] == [[]]
    with pytest.raises(FileNotFoundError):
        windows.WindowReader({"path": str(tmp_path / "gone")}).partitions()
