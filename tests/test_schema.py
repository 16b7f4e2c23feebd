"""Placed fields and reports: slots, dynamic fields, repeated and cleared values, facets, exports, sections and options."""

import pytest

from reelframe.functions import schema as core
from reelframe.operators import schema as op

FIELDS = "file string, kind string, idx int, seq int, name string, text string, measure string, options string"
ROWS = [
    ("f", "General", 0, 0, "CompleteName", "/a & b", None, None), ("f", "General", 0, 1, "Format", "MPEG-4", None, None), ("f", "General", 0, 2, "Mood", "x", None, None), ("f", "General", 0, 3, "Mood", "calm", " m", "N YTY"),
    ("f", "General", 0, 4, "Duration", "1021.5", None, None), ("f", "General", 0, 5, "Gone", "", None, None), ("f", "General", 0, 6, "Late", "é\"<", None, None), ("f", "General", 0, 7, "Album", "A", None, None), ("f", "General", 0, 8, "Album", "", None, None),
    ("f", "Video", 1, 0, "Width/String", "64 pixels", None, None), ("f", "Video", 0, 0, "Format_Profile", "Main 10@L4@L5@@Main", None, None), ("f", "Video", 0, 1, "Format_Version", "Version 4", None, None),
    ("f", "Menu", 0, 0, "00:00:00.000", "Start", None, None), (None, "Video", 0, 0, "Format", "x", None, None), ("f", None, 0, 0, "Format", "x", None, None), ("g", "Audio", 3, 0, "Count", "7", None, None), ("g", "Audio", 3, 1, None, "7", None, None),
]


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(ROWS, FIELDS).repartition(3)


def reports(frame):
    return {r.file: r.report for r in frame.collect()}


def test_fields_stand_in_their_slots(spark, fields):
    rows = sorted((r.kind, r.idx, r.pos, r.name, r.text, r.options, r.dynamic) for r in op.placed(fields).collect() if r.file == "f")
    general = len([x for x in core.core_rows() if x[0] == "General"])
    assert [x[2:5] for x in rows if x[0] == "General"] == [(9, "CompleteName", "/a & b"), (11, "Format", "MPEG-4"), (19, "Duration", "1021.5"), (general, "Mood", "calm"), (general + 2, "Late", 'é"<')]
    assert [x[2:] for x in rows if x[0] == "Menu"] == [(0, "00:00:00.000", "Start", "Y NT", True)]
    counts = {(r.kind, r.idx): r["count"] for r in op.count_get(fields, core.core(spark)).collect()}
    assert counts["General", 0] == general + 3 and counts["Menu", 0] == 1


def test_facets_of_slots_with_and_without_values(spark, fields):
    dimension = core.core(spark)
    asked = lambda position, what: {(r.file, r.kind, r.idx): r.value for r in op.get_at(fields, dimension, position, what).collect()}
    assert asked(19, "text")["f", "General", 0] == "1021.5" and asked(19, "measure")["f", "General", 0] == " ms" and asked(19, "measure_text")["f", "General", 0] == "ms"
    assert asked(17, "text")["f", "General", 0] == "" and asked(17, "name")["f", "General", 0] == "FileSize" and asked(17, "options")["f", "General", 0] == "N YTY"
    assert asked(31, "name")["f", "General", 0] == "Mood" and asked(31, "options")["f", "General", 0] == "N YTY" and asked(99, "text")["f", "General", 0] == "" and asked(19, "info")["f", "General", 0] == ""
    with pytest.raises(ValueError):
        op.facet("colour")
    assert {(r.file, r.kind, r.idx): r.text for r in op.get(fields, "Album").collect()}["f", "General", 0] == ""


def test_text_report(spark, fields):
    line = lambda label, text: f"{label:<41}: {text}\n"
    got = reports(op.text_report(fields))
    assert got["f"] == "General\n" + line("Complete name", "/a & b") + line("Late", 'é"<') + "\nVideo #1\n" + line("Format version", "Version 4") + line("Format profile", "Main 10@L4@L5@@Main") + "\nVideo #2\n" + line("Width", "64 pixels") + "\nMenu\n" + line("00:00:00.000", "Start") + "\n"
    assert got["g"] == "Audio\n\n"
    assert line("Width/String", "64 pixels") in reports(op.text_report(fields, raw_names=True))["f"] and line("Mood", "calm") in reports(op.text_report(fields, complete=True))["f"]
    plan = op.text_report(fields, core.core(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(file") == 1 and "Python" not in plan


def test_exports(fields):
    xml, json, old = (reports(op.inform(fields, op.Options().option("Output", x)[1]))["f"] for x in ("xml", "JSON", "OLDXML"))
    assert '<media ref="/a &amp; b">' in xml and xml.endswith("</media>\n</MediaReport>\n")
    assert '<track type="General">\n<Format>MPEG-4</Format>\n<Duration>1.0215</Duration>\n<extra>\n<Mood>calm</Mood>\n<Late>é&quot;&lt;</Late>\n</extra>\n</track>\n' in xml
    assert '<track type="Video" typeorder="1">\n<Format_Version>4</Format_Version>\n<Format_Profile>Main 10</Format_Profile>\n<Format_Level>4</Format_Level>\n<Format_Tier>Main</Format_Tier>\n</track>\n<track type="Video" typeorder="2">\n</track>\n' in xml
    assert '"@ref": "/a & b",' in json and ',\n"extra": {\n"Mood": "calm",\n"Late": "é\\"<"\n}\n}' in json and '{\n"@type": "Menu",\n"extra": {\n"_00_00_00_000": "Start"\n}\n}\n]\n}\n}\n' in json
    import json as reader

    assert [t["@type"] for t in reader.loads(json)["media"]["track"]] == ["General", "Video", "Video", "Menu"]
    assert '<track type="Video" streamid="2">\n<Width>64 pixels</Width>\n</track>\n' in old and "calm" not in old


def test_sections(fields):
    told = lambda text: reports(op.inform(fields, op.Options().option("Inform", text)[1]))
    assert told("General;%CompleteName%|%Mood%\\nVideo;%Width/String%x%Height%\\n")["f"] == "/a & b|calm\nx\n64 pixelsx\n"
    assert told("%Format% $if(%Duration%,has,none)") == {"f": "MPEG-4 has", "g": ""}
    assert told("head\\nVideo;v\\nmore\\nMenu;%00:00:00.000% 100%")["f"] == "head\nv\nmore\nv\nmore\nStart 100%"
    assert op.sections("a\\nVideo;b\\n c\\nGeneral;") == ("a\n", [("Video", "b\n c\n"), ("General", "")])


def test_options():
    options = op.Options()
    assert options.option("Nonsense")[0] == "Option not known" and options.option("ParseSpeed", "1")[1].other == {"ParseSpeed": "1"}
    assert options.option("Complete", "yes")[1].complete and not options.option("complete", "0")[1].complete and options.option("Language", "RAW")[1].raw_names
    changed = options.option("Inform", "General;%Format%")[1]
    assert changed.template and changed.option("Inform", "")[1].template is None and changed.option("Output", "EBUCore")[1].other == {"Output": "EBUCore"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIELDS)
    assert all(op.inform(none, op.Options(output=x)).count() == 0 for x in ("TEXT", "XML", "OLDXML", "JSON")) and op.section_report(none, "x").count() == 0 and op.placed(none).count() == 0
