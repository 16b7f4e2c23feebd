"""Tags of several sources: rules, order of sources, splits, extras and empty values."""

from reelframe.operators import tagmaps

TAGS = "file string, source string, seq int, key string, text string"


def test_rules(spark):
    tags = spark.createDataFrame([
        ("f", "b", 0, "title", "late source"), ("f", "a", 5, "TITLE", "first"), ("f", "a", 6, "Title", "second"), ("f", "a", 1, "artist", "x"), ("f", "a", 2, "artist", "y"), ("f", "b", 0, "Artist", "x"), ("f", "b", 1, "Artist", "z"),
        ("f", "a", 1, "track", "3 / 12"), ("f", "a", 2, "track", "4"), ("f", "c", 0, "odd", "o1"), ("f", "a", 0, "odd", "o2"), ("f", "a", 0, "title", ""), ("f", "a", 0, "title", None), ("f", "a", 0, None, "n"), (None, "a", 0, "title", "n"), ("f", "a", 9, "note", "1"), ("f", "b", 0, "note", "2"),
    ], TAGS)
    maps = spark.createDataFrame([("a", "Title", "Title", "first", None), ("b", "TITLE", "Title", "first", None), ("a", "artist", "Performer", "join", None), ("b", "artist", "Performer", "first", None), ("a", "track", "Track", "last", "position"), ("a", "note", "Comment", "last", None), ("b", "note", "Comment", "first", None)], "source string, key string, field string, rule string, part string")
    got = {(r.file, r.field): (r.text, r.extra) for r in tagmaps.resolved(tags.repartition(3), maps, ["a", "b"]).collect()}
    assert got == {("f", "Title"): ("first", False), ("f", "Performer"): ("x / y / z", False), ("f", "Track"): ("4", False), ("f", "Track_Total"): ("12", False), ("f", "odd"): ("o2", True), ("f", "Comment"): ("2", False)}
    assert tagmaps.resolved(tags.limit(0), maps, ["a"]).count() == 0
