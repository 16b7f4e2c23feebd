"""Fields of streams in three layouts: one map per stream, one row per field, one typed column per field."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.text import export_name, json_escape, xml_escape

#: Width of labels in text reports.
LABEL_WIDTH = 41


def to_rows(streams: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, pos, name, text of every field that has a value, in the order of fields."""
    entries = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), F.col(n).cast("string").alias("text")) for k, n in enumerate(fields)))
    return streams.select(*keys, F.explode(F.filter(entries, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("x")).select(*keys, "x.*")


def to_columns(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One column per field; the names are given, so no job is needed to find them."""
    return rows.groupBy(*keys).pivot("name", fields).agg(F.first("text"))


def get(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The text of a field, empty where it is missing."""
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("name") == name, F.col("text"))), F.lit("")).alias("text"))


def get_at(rows: DataFrame, keys: list[str], position: int) -> DataFrame:
    return rows.filter(F.col("pos") == position).select(*keys, "name", "text")


def count_get(rows: DataFrame, keys: list[str], schema_size: int) -> DataFrame:
    """Fields of a stream: the slots of the schema and the dynamic ones behind them."""
    return rows.groupBy(*keys).agg((F.lit(schema_size) + F.count_if(F.col("pos") >= schema_size)).alias("count"))


def ordered(line: Column, *order: str) -> Column:
    """Lines joined in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(*order, line.alias("__line")))).getField("__line"), "")


def text_line(label: Column, text: Column) -> Column:
    """A label padded to its width, never cut."""
    padded = F.when(F.length(label) >= LABEL_WIDTH, label).otherwise(F.rpad(label, LABEL_WIDTH, " "))
    return F.concat(padded, F.lit(": "), text, F.lit("\n"))


def _bodies(rows: DataFrame, file: str, line: Callable[[Column, Column], Column], fields: list[str] | None) -> DataFrame:
    """A row per stream that has a field: body (its lines), place (its number in its kind), among (the kind's count).

    rows: a row per field; with fields, a row per stream with a column for each of these, which needs no grouping.
    """
    keys = [file, "kind_id", "kind", "idx"]
    if fields is None:
        streams = rows.groupBy(*keys).agg(ordered(line(F.col("name"), F.col("text")), "pos").alias("body"))
    else:
        texts = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in fields}
        streams = rows.select(*keys, F.concat(*(F.when(t != "", line(F.lit(n), t)).otherwise("") for n, t in texts.items())).alias("body")).filter("body <> ''")
    own = Window.partitionBy(file, "kind_id")
    return streams.withColumns({"place": F.row_number().over(own.orderBy("idx")), "among": F.count(F.lit(1)).over(own)})


def text_report(rows: DataFrame, file: str = "file", fields: list[str] | None = None) -> DataFrame:
    """A text report per file: kinds in order, a heading per stream, a line per field, a blank line after each stream. rows, fields: see `_bodies`."""
    head = F.when(F.col("among") > 1, F.concat("kind", F.lit(" #"), F.col("place").cast("string"), F.lit("\n"))).otherwise(F.concat("kind", F.lit("\n")))
    return _bodies(rows, file, text_line, fields).groupBy(file).agg(ordered(F.concat(head, "body", F.lit("\n")), "kind_id", "idx").alias("report"))


def xml_report(rows: DataFrame, file: str = "file", old: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Tracks of a file with an element per field; old has streamid for the number and no double underscores."""
    attribute = "streamid" if old else "typeorder"
    head = F.concat(F.lit('<track type="'), "kind", F.when(F.col("among") > 1, F.concat(F.lit(f'" {attribute}="'), F.col("place").cast("string"))).otherwise(""), F.lit('">\n'))

    def line(name: Column, text: Column) -> Column:
        own = F.replace(export_name(name), F.lit("__"), F.lit("_")) if old else export_name(name)
        return F.concat(F.lit("<"), own, F.lit(">"), xml_escape(text), F.lit("</"), own, F.lit(">\n"))

    return _bodies(rows, file, line, fields).groupBy(file).agg(ordered(F.concat(head, "body", F.lit("</track>\n")), "kind_id", "idx").alias("report"))


def json_report(rows: DataFrame, file: str = "file", fields: list[str] | None = None) -> DataFrame:
    """Tracks of a file as JSON objects, all values strings."""
    head = F.concat(F.lit('{\n"@type": "'), "kind", F.lit('"'), F.when(F.col("among") > 1, F.concat(F.lit(',\n"@typeorder": "'), F.col("place").cast("string"), F.lit('"'))).otherwise(""))
    line = lambda name, text: F.concat(F.lit(",\n"), json_escape(export_name(name)), F.lit(": "), json_escape(text))
    tracks = F.sort_array(F.collect_list(F.struct("kind_id", "idx", F.concat(head, "body", F.lit("\n}")).alias("x")))).getField("x")
    return _bodies(rows, file, line, fields).groupBy(file).agg(F.array_join(tracks, ",\n").alias("report"))


def template(text: str, fields: dict[str, Column]) -> Column:
    """A template compiled into one expression: %Name% is a field (empty where unknown), $if(%A%,yes,no) tests for text.

    Arguments of $if are literal text with fields; a lone % stays. Branches are not read again.
    """
    text = text.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t")

    def plain(part: str) -> Column:
        pieces = part.split("%")
        if len(pieces) % 2 == 0:
            pieces[-2:] = [pieces[-2] + "%" + pieces[-1]]
        out = [F.lit(p) if k % 2 == 0 else F.coalesce(fields[p].cast("string"), F.lit("")) if p in fields else F.lit("") for k, p in enumerate(pieces) if p or k % 2]
        return F.concat(*out) if out else F.lit("")

    found, rest = [], text
    while (at := rest.find("$if(")) >= 0:
        found.append(plain(rest[:at]))
        depth, end = 1, at + 4
        while end < len(rest) and depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        if depth:
            found.append(plain(rest[at:]))
            rest = ""
            break
        condition, yes, no = ([*rest[at + 4 : end - 1].split(",", 2), "", ""])[:3]
        found.append(F.when(plain(condition) != "", plain(yes)).otherwise(plain(no)))
        rest = rest[end:]
    found.append(plain(rest))
    return F.concat(*found)


def label(name: Column, labels: dict[str, str]) -> Column:
    """The label of a field name, else of the name without /String, else the name."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.element_at(table, name), F.element_at(table, F.regexp_replace(name, "/String[0-9]*$", "")), name)


def mapped_tags(tags: DataFrame, mapping: dict[str, str], key: str = "tag", value: str = "text") -> DataFrame:
    """Tags renamed by a fixed table; unknown ones keep their name and are marked as extra."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    target = F.element_at(table, F.upper(F.col(key)))
    return tags.withColumns({"name": F.coalesce(target, F.col(key)), "extra": target.isNull()})


def compared(mine: DataFrame, other: DataFrame, keys: list[str], value: str, allowed: DataFrame | None = None) -> DataFrame:
    """Full outer difference of two field tables: missing, extra, different; allowed keys are left out."""
    both = mine.select(*keys, F.col(value).alias("mine")).join(other.select(*keys, F.col(value).alias("other")), keys, "full_outer")
    state = F.when(F.col("mine").isNull(), "missing").when(F.col("other").isNull(), "extra").when(F.col("mine") != F.col("other"), "different")
    out = both.withColumn("state", state).filter("state IS NOT NULL")
    return out if allowed is None else out.join(allowed, allowed.columns, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
