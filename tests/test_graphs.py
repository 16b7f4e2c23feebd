"""Graphs of sets: breadth-first walks against plain Python, and tracks with missing, repeated and alone-standing sets."""

import random

import pytest

from reelframe.operators import graphs as op

SETS = "file string, uid string, kind string, track_id long, num long, den long, definition long, duration long, start long, base long, dropped long, linked long"
REFS = "file string, uid string, role string, position int, target string"


def sets_of(spark, rows):
    return spark.createDataFrame([("f", u, k, *(more.get(c.split()[0]) for c in SETS.split(", ")[3:])) for u, k, more in rows], SETS)


def refs_of(spark, rows):
    return spark.createDataFrame([("f", *r) for r in rows], REFS)


def walked(known, refs, root, depth):
    """(owner, role, position, uid, depth, path, state) in the order of levels."""
    out, entered, front = [], {root}, [(root, "", [root])]
    for level in range(1, depth + 1):
        met = [(f"{path}/{role}" if path else role, owner, position, target, role, owners) for owner, path, owners in front for o, role, position, target in refs if o == owner]
        best, front = {}, []
        for m in met:
            best[m[3]] = min(best.get(m[3], m[:3]), m[:3])
        for path, owner, position, target, role, owners in met:
            if target not in known:
                state = "missing"
            elif target in owners:
                state = "cycle"
            elif target in entered or (path, owner, position) != best[target]:
                state = "again"
            else:
                state = "deep" if level == depth else "whole"
            out.append((owner, role, position, target, level, path, state))
            if state == "whole":
                front.append((target, path, owners + [target]))
        entered |= {f[0] for f in front}
    return out


@pytest.mark.parametrize("seed,depth", [(1, 3), (2, 8), (3, 1)])
def test_reached_equals_a_plain_walk(spark, seed, depth):
    r = random.Random(seed)
    known = [f"u{k}" for k in range(14)]
    refs = sorted({(r.choice(known), r.choice("ab"), r.randint(0, 3), r.choice(known + ["gone", "lost"])) for _ in range(30)})
    sets = sets_of(spark, [(u, "K", {}) for u in known] + [("u1", "K", {})])
    roots = spark.createDataFrame([("f", "u0"), ("f", "u0"), ("f", "u5"), ("g", "u0")], "file string, uid string")
    got = op.reached(sets, refs_of(spark, refs + refs[:3]), roots, depth).collect()
    for root in ("u0", "u5"):
        mine = sorted((x.owner, x.role, x.position, x.uid, x.depth, x.path, x.state) for x in got if x.root == root)
        assert mine == sorted(walked(set(known), refs, root, depth))
    assert {x.file for x in got} <= {"f"}
    assert op.reached(sets.limit(0), refs_of(spark, refs).limit(0), roots.limit(0)).count() == 0


def test_tracks_take_sequence_and_components(spark):
    rate = {"track_id": 1, "num": 25, "den": 1}
    sets = sets_of(spark, [
        ("P", "MaterialPackage", {}), ("S", "SourcePackage", {}), ("A", "TimelineTrack", rate), ("B", "StaticTrack", rate), ("C", "OtherTrack", rate), ("D", "EventTrack", rate), ("A", "TimelineTrack", rate),
        ("QA", "Sequence", {"definition": 1}), ("QB", "TimecodeComponent", {"duration": 7, "start": 5}), ("QD", "Sequence", {"definition": 2, "duration": 9}),
        ("c1", "Filler", {"duration": 1}), ("c2", "SourceClip", {}), ("c3", "SourceClip", {"duration": 50}), ("c4", "SourceClip", {"duration": 60}), (None, "Sequence", {}),
    ])
    refs = refs_of(spark, [("P", "Tracks", k, t) for k, t in enumerate(["A", "B", "C", "gone", "D"])] + [("A", "Sequence", 0, "QA"), ("B", "Sequence", 0, "QB"), ("D", "Sequence", 0, "QD")] + [("QA", "Components", k, c) for k, c in enumerate(["c1", "c2", "c3", "c4", "lost"])] + [("QA", "Components", 0, "c1")])
    got = {r.track: (r.data, r.duration, r.start, r.base) for r in op.package_tracks(sets, refs).collect()}
    assert got == {"A": (1, 50, None, None), "B": (4, 7, 5, 0), "D": (2, 9, None, None)}
    assert [tuple(r) for r in op.file_durations(op.package_tracks(sets, refs)).collect()] == [("f", 2000)]


def test_descriptors_by_link_then_alone_then_class(spark):
    track = lambda u, n, d: (u, "TimelineTrack", {"track_id": n})
    sets = sets_of(spark, [
        ("S", "SourcePackage", {}), track("A", 1, 1), track("B", 2, 2), track("C", 3, 1), ("QA", "Sequence", {"definition": 1}), ("QB", "Sequence", {"definition": 2}), ("QC", "Sequence", {"definition": 3}),
        ("M", "MultipleDescriptor", {}), ("d1", "PictureDescriptor", {}), ("d2", "SoundDescriptor", {"linked": 1}), ("d3", "SoundDescriptor", {}),
    ])
    refs = refs_of(spark, [("S", "Tracks", k, t) for k, t in enumerate("ABC")] + [(t, "Sequence", 0, "Q" + t) for t in "ABC"] + [("S", "Descriptor", 0, "M")] + [("M", "SubDescriptors", k, d) for k, d in enumerate(["d1", "none", "d2", "d3"])])
    tracks = op.package_tracks(sets, refs)
    got = {r.track: r.descriptor for r in op.described(tracks, op.package_descriptors(sets, refs)).collect()}
    assert got == {"A": "d2", "B": "d2", "C": None}
