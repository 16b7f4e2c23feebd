"""Fields placed by a schema: slots, labels, measures and options as a dimension that orders, names, shows and exports them.

fields: file, kind, idx (a stream's number in its kind), seq (the order in which fields were set), name, text, and measure and
options of fields outside the schema (null: none, "Y NT"). dimension: kind, slot, name, measure, options, label, one row a field. A field of the schema stands
in its slot; others follow behind the schema in the order in which they were first set. Of several values of a field the last
one counts, and an empty or null one clears it. Names are told apart by case; rows without a file, kind or name are left out.

Everything about a file meets in one exchange by file: placing, numbering and rendering work in the partitions that it makes. A report is
one value of a file, so a file's fields belong to one task; files spread over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions import schema
from reelframe.functions.text import export_name, json_escape, ms_to_seconds, xml_escape
from reelframe.operators.fields import ordered, text_line

STREAM = ["file", "kind", "idx"]
#: A fixed value: options of a field that isn't in the schema.
SHOWN = "Y NT"
#: Fields of the engine that exports leave out.
INNER = ["Count", "StreamCount", "StreamKind", "StreamKind/String", "StreamKindID", "StreamKindPos", "Status", "Inform"]


def kind_number(kind: Column) -> Column:
    """Place of a kind in reports; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, schema.KINDS)), kind), F.lit(0)), F.lit(len(schema.KINDS) + 1)).cast("int")


def placed(fields: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """file, kind, idx, pos, name, text, measure, options, label, dynamic: the fields with a value at their positions."""
    dimension = schema.core(fields.sparkSession) if dimension is None else dimension
    sizes = dimension.groupBy("kind").agg((F.max("slot") + 1).alias("slots"))
    known = dimension.select("kind", "name", "slot", F.col("measure").alias("own_measure"), F.col("options").alias("own_options"), "label")
    own = fields.filter("file IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL").repartition("file")
    one = own.groupBy(*STREAM, "name").agg(F.min("seq").alias("first"), F.max_by(F.struct("text", "measure", "options"), "seq").alias("x"))
    joined = one.join(known, ["kind", "name"], "left").join(sizes, "kind", "left")
    dynamic = F.col("slot").isNull()
    behind = F.row_number().over(Window.partitionBy(*STREAM, dynamic).orderBy("first", "name")) - 1 + F.coalesce("slots", F.lit(0))
    return joined.withColumn("behind", behind).filter(F.coalesce("x.text", F.lit("")) != "").select(
        *STREAM, F.when(dynamic, F.col("behind")).otherwise(F.col("slot")).alias("pos"), "name", F.col("x.text").alias("text"),
        F.when(dynamic, F.coalesce("x.measure", F.lit(""))).otherwise(F.col("own_measure")).alias("measure"), F.when(dynamic, F.coalesce("x.options", F.lit(SHOWN))).otherwise(F.col("own_options")).alias("options"),
        F.when(dynamic, schema.label(F.col("name"))).otherwise(F.col("label")).alias("label"), dynamic.alias("dynamic"),
    )


#: What can be asked about a field, by its number in the interface.
FACET_NAMES = ["name", "text", "measure", "options", "label", "measure_text", "info", "how_to"]


def facet(what: str) -> Column:
    """A facet of placed fields: name, text, measure, options, label, measure_text; info and how_to are empty."""
    if what not in FACET_NAMES:
        raise ValueError(f"{what} is none of {', '.join(FACET_NAMES)}")
    return F.lit("") if what in ("info", "how_to") else F.trim("measure") if what == "measure_text" else F.col(what)


def get_at(fields: DataFrame, dimension: DataFrame, position: int, what: str = "text") -> DataFrame:
    """file, kind, idx, value of the field at a position of every stream: also a slot without a value has a name, measure and options.

    Positions behind the schema that a stream doesn't have are empty.
    """
    streams = fields.filter("file IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL").select(*STREAM).distinct()
    slot = dimension.filter(F.col("slot") == position).select("kind", "name", F.lit("").alias("text"), "measure", "options", "label")
    bare = streams.join(slot, "kind", "left").withColumn("bare", F.coalesce(facet(what), F.lit("")))
    found = placed(fields, dimension).filter(F.col("pos") == position).select(*STREAM, facet(what).alias("found"))
    return bare.join(found, STREAM, "left").select(*STREAM, F.coalesce("found", "bare").alias("value"))


def get(fields: DataFrame, name: str) -> DataFrame:
    """file, kind, idx, text of one field of every stream, empty where it is missing: only its rows are grouped."""
    own = fields.filter("file IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL").repartition("file")
    value = F.max_by(F.when(F.col("name") == name, F.coalesce("text", F.lit(""))), F.when(F.col("name") == name, F.col("seq")))
    return own.groupBy(*STREAM).agg(F.coalesce(value, F.lit("")).alias("text"))


def count_get(fields: DataFrame, dimension: DataFrame) -> DataFrame:
    """file, kind, idx, count: a stream's slots and the fields behind them."""
    sizes = dimension.groupBy("kind").agg((F.max("slot") + 1).alias("slots"))
    own = fields.filter("file IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL").repartition("file")
    names = own.select(*STREAM, "name").distinct().join(dimension.select("kind", "name", "slot"), ["kind", "name"], "left")
    return names.groupBy(*STREAM).agg(F.count_if(F.col("slot").isNull()).alias("behind")).join(sizes, "kind", "left").select(*STREAM, (F.col("behind") + F.coalesce("slots", F.lit(0))).alias("count"))


def exports() -> Column:
    """(name, value) pairs that a placed field gives in XML and JSON: seconds for milliseconds, profile, level and tier apart."""
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    parts = F.split("text", "@")
    rest = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != "")
    own = lambda p: F.when(p.startswith("L"), pair(F.lit("Format_Level"), F.substring(p, F.lit(2), F.length(p)))).otherwise(pair(F.lit("Format_Tier"), p))
    profile = F.concat(F.array(pair(F.lit("Format_Profile"), F.get(parts, F.lit(0)))), F.transform(rest, own))
    version = F.regexp_replace("text", "^Version ", "")
    whole = F.when(F.col("measure") == " ms", F.array(pair(F.col("name"), ms_to_seconds(F.col("text"))))).when(F.col("name") == "Format_Version", F.array(pair(F.col("name"), version)))
    return whole.when(F.col("name") == "Format_Profile", profile).otherwise(F.array(pair(F.col("name"), F.col("text"))))


def is_exported() -> Column:
    return (F.col("dynamic") | (F.substring("options", 5, 1) == "Y")) & ~F.col("name").isin(INNER)


def _streams(rows: DataFrame, *bodies: Column) -> DataFrame:
    """A row a stream with its bodies, its place in its kind and the kind's count; no further exchange."""
    own = Window.partitionBy("file", "kind")
    grouped = rows.groupBy(*STREAM).agg(*bodies)
    return grouped.withColumns({"place": F.row_number().over(own.orderBy("idx")), "among": F.count(F.lit(1)).over(own), "kind_id": kind_number(F.col("kind"))})


def _files(streams: DataFrame, block: Column, between: str, *more: Column) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind_id", "kind", "idx", block.alias("x")))), lambda s: s["x"]), between)
    return streams.groupBy("file").agg(joined.alias("body"), *more)


def _lines(line: Column, where: Column, nth: Column | None = None) -> Column:
    """Lines of the fields that pass, in order; a null element is left out by collect_list."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("pos", (F.lit(0) if nth is None else nth).alias("nth"), line.alias("line"))))), lambda x: x["line"]), "")


def text_report(fields: DataFrame, dimension: DataFrame | None = None, complete: bool = False, raw_names: bool = False) -> DataFrame:
    """file, report: a heading and the shown fields of each stream under their labels, a blank line between streams and at the end."""
    shown = F.lit(True) if complete else F.substring("options", 1, 1) == "Y"
    streams = _streams(placed(fields, dimension), _lines(text_line(F.col("name" if raw_names else "label"), F.col("text")), shown).alias("lines"))
    head = F.concat("kind", F.when(F.col("among") > 1, F.concat(F.lit(" #"), F.col("place").cast("string"))).otherwise(""), F.lit("\n"))
    return _files(streams, F.concat(head, "lines"), "\n").select("file", F.concat("body", F.lit("\n")).alias("report"))


@dataclass(frozen=True)
class Library:
    """What preambles say of the library that wrote a report."""

    name: str = "reelframe"
    version: str = "1.0"
    url: str = "urn:reelframe"
    namespace: str = "urn:reelframe:media:2.0"
    root: str = "MediaReport"  # the outermost element


def _complete_name() -> Column:
    return F.max(F.when((F.col("kind") == "General") & (F.col("name") == "CompleteName"), F.col("text"))).alias("complete")


def _track(attribute: str) -> Column:
    return F.concat(F.lit('<track type="'), "kind", F.when(F.col("among") > 1, F.concat(F.lit(f'" {attribute}="'), F.col("place").cast("string"))).otherwise(""), F.lit('">\n'))


def _exported(rows: DataFrame) -> DataFrame:
    """Rows of exported pairs, and a bare row for every stream, so that none is lost; of two levels or tiers of a stream the first counts."""
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value")))
    pairs = rows.select("*", F.posexplode(F.when(is_exported(), exports()).otherwise(none)).alias("nth", "pair"))
    again = F.row_number().over(Window.partitionBy(*STREAM, "pair.name").orderBy("pos", "nth"))
    kept = pairs.withColumn("again", again).filter(F.col("pair.name").isNull() | ~F.col("pair.name").isin("Format_Level", "Format_Tier") | (F.col("again") == 1))
    return kept.withColumns({"out": export_name(F.col("pair.name")), "value": F.col("pair.value")})


def xml_report(fields: DataFrame, dimension: DataFrame | None = None, library: Library = Library()) -> DataFrame:
    """file, report: a preamble, tracks with an element per exported field, dynamic ones within `extra`."""
    line = F.concat(F.lit("<"), "out", F.lit(">"), xml_escape(F.col("value")), F.lit("</"), "out", F.lit(">\n"))
    there = F.coalesce(F.col("value"), F.lit("")) != ""
    streams = _streams(_exported(placed(fields, dimension)), _lines(line, there & ~F.col("dynamic"), F.col("nth")).alias("lines"), _lines(line, there & F.col("dynamic"), F.col("nth")).alias("more"), _complete_name())
    more = F.when(F.col("more") != "", F.concat(F.lit("<extra>\n"), "more", F.lit("</extra>\n"))).otherwise("")
    whole = _files(streams, F.concat(_track("typeorder"), "lines", more, F.lit("</track>\n")), "", F.max("complete").alias("complete"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<{library.root}\n    xmlns="{library.namespace}"\n    version="2.0">\n<creatingLibrary version="{library.version}" url="{library.url}">{library.name}</creatingLibrary>\n<media ref="'
    return whole.select("file", F.concat(F.lit(head), xml_escape(F.coalesce("complete", F.lit(""))), F.lit('">\n'), "body", F.lit(f"</media>\n</{library.root}>\n")).alias("report"))


def old_xml_report(fields: DataFrame, dimension: DataFrame | None = None, library: Library = Library()) -> DataFrame:
    """file, report: the older layout, an element per shown field under its label."""
    name = F.replace(export_name(F.col("label")), F.lit("__"), F.lit("_"))
    line = F.concat(F.lit("<"), name, F.lit(">"), xml_escape(F.col("text")), F.lit("</"), name, F.lit(">\n"))
    streams = _streams(placed(fields, dimension), _lines(line, F.substring("options", 1, 1) == "Y").alias("lines"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<{library.root} version="{library.version}">\n<File>\n'
    return _files(streams, F.concat(_track("streamid"), "lines", F.lit("</track>\n")), "").select("file", F.concat(F.lit(head), "body", F.lit(f"</File>\n</{library.root}>\n")).alias("report"))


def json_report(fields: DataFrame, dimension: DataFrame | None = None, library: Library = Library()) -> DataFrame:
    """file, report: a preamble and tracks as objects of strings, dynamic fields within `extra`."""
    line = F.concat(F.lit(",\n"), json_escape(F.col("out")), F.lit(": "), json_escape(F.col("value")))
    there = F.coalesce(F.col("value"), F.lit("")) != ""
    streams = _streams(_exported(placed(fields, dimension)), _lines(line, there & ~F.col("dynamic"), F.col("nth")).alias("lines"), _lines(line, there & F.col("dynamic"), F.col("nth")).alias("more"), _complete_name())
    head = F.concat(F.lit('{\n"@type": "'), "kind", F.lit('"'), F.when(F.col("among") > 1, F.concat(F.lit(',\n"@typeorder": "'), F.col("place").cast("string"), F.lit('"'))).otherwise(""))
    more = F.when(F.col("more") != "", F.concat(F.lit(',\n"extra": {\n'), F.substring("more", F.lit(3), F.length("more")), F.lit("\n}"))).otherwise("")
    whole = _files(streams, F.concat(head, "lines", more, F.lit("\n}")), ",\n", F.max("complete").alias("complete"))
    start = f'{{\n"creatingLibrary": {{\n"name": "{library.name}",\n"version": "{library.version}",\n"url": "{library.url}"\n}},\n"media": {{\n"@ref": '
    return whole.select("file", F.concat(F.lit(start), json_escape(F.coalesce("complete", F.lit(""))), F.lit(',\n"track": [\n'), "body", F.lit("\n]\n}\n}\n")).alias("report"))


def sections(template: str) -> tuple[str, list[tuple[str, str]]]:
    """What stands before the first section, and (kind, text) of each: a line `Kind;text` opens one, other lines go on with it."""
    before, found = "", []
    for line in template.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t").splitlines(keepends=True):
        kind = next((k for k in schema.KINDS if line.rstrip("\n").startswith(f"{k};")), None)
        if kind:
            found.append([kind, line[len(kind) + 1 :]])
        elif found:
            found[-1][1] += line
        else:
            before += line
    return before, [tuple(x) for x in found]


def section_report(fields: DataFrame, template: str) -> DataFrame:
    """file, report: each section for every stream of its kind, in order; a template without sections goes to the general streams.

    %Name% is a field's text, empty where it is missing; $if(%A%,yes,no) asks for text. A section is one expression over a stream's
    fields, compiled once; texts are values and are not read again as templates. A file without a matching stream has what stands before.
    """
    from reelframe.operators.fields import template as compiled

    before, found = sections(template)
    own = fields.filter("file IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL").repartition("file")
    one = own.groupBy(*STREAM, "name").agg(F.max_by("text", "seq").alias("text"))
    streams = one.groupBy(*STREAM).agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("text", F.lit("")).alias("text")))).alias("values"))
    names = _Values()
    parts = [(k, kind, compiled(text, names)) for k, (kind, text) in enumerate(found)] or [(0, "General", compiled(before, names))]
    made = F.filter(F.array(*(F.when(F.col("kind") == kind, F.struct(F.lit(k).alias("section"), F.col("idx"), text.alias("text"))) for k, kind, text in parts)), lambda x: x.isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list(made))), lambda x: x["text"]), "")
    return streams.groupBy("file").agg(F.concat(F.lit(before if found else ""), joined).alias("report"))


class _Values(dict):
    """Every name is a field: a lookup in the stream's map."""

    def __contains__(self, name: object) -> bool:
        return True

    def __getitem__(self, name: str) -> Column:
        return F.coalesce(F.element_at("values", F.lit(name)), F.lit(""))


@dataclass(frozen=True)
class Options:
    """Settings of a report, changed by name as the interface does; every change gives the reply and new options."""

    output: str = "TEXT"
    template: str | None = None
    complete: bool = False
    raw_names: bool = False
    other: dict[str, str] = field(default_factory=dict)

    def option(self, name: str, value: str = "") -> tuple[str, Options]:
        key, value = name.strip().lower(), value.strip()
        if key in ("complete", "full"):
            return "", replace(self, complete=value.lower() in ("1", "true", "yes"))
        if key == "language":
            return "", replace(self, raw_names=value.lower() == "raw")
        if key in ("output", "inform"):
            known = {"": "TEXT", "TXT": "TEXT"}.get(value.upper(), value.upper())
            if known in ("TEXT", "XML", "OLDXML", "JSON"):
                return "", replace(self, output=known, template=None if key == "inform" else self.template)
            return "", replace(self, template=value) if key == "inform" else replace(self, output="TEXT", other=self.other | {"Output": value})
        if key in ("charset", "parsespeed", "internet", "showfiles", "cover_data"):
            return "", replace(self, other=self.other | {name: value})
        return "Option not known", self


def inform(fields: DataFrame, options: Options = Options(), dimension: DataFrame | None = None, library: Library = Library()) -> DataFrame:
    """file, report in the chosen output; a template goes before it."""
    if options.template is not None:
        return section_report(fields, options.template)
    if options.output == "XML":
        return xml_report(fields, dimension, library)
    if options.output == "OLDXML":
        return old_xml_report(fields, dimension, library)
    if options.output == "JSON":
        return json_report(fields, dimension, library)
    return text_report(fields, dimension, options.complete, options.raw_names)
