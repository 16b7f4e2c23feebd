"""Descriptions from a list handed out to streams: by key where one fits, else the first that nobody has taken.

streams and entries: file, kind, key, number (their order). Both forms give every stream at most one entry and every entry to at
most one stream; null and empty keys fit nothing; numbers are distinct within a file and kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("number")))


def keyed_first(streams: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """All keyed matches first, then the leftovers of both sides in order: two joins on ranks, for lists of any length.

    file, kind, number, value (null: none was left), keyed (the key fitted).
    """
    keys = ["file", "kind", "key"]
    full = F.coalesce(F.col("key"), F.lit("")) != ""
    mine = _ranked(streams.select(*keys, "number"), keys, "rank")
    theirs = _ranked(entries.select(*keys, "number", value), keys, "rank")
    held = theirs.filter(full).select(*keys, "rank", F.col("number").alias("entry"), F.col(value).alias("held"))
    first = mine.join(held, [*keys, "rank"], "left").withColumn("keyed", F.col("entry").isNotNull() & full)
    rest = _ranked(first.filter("NOT keyed").select("file", "kind", "number"), ["file", "kind"], "place")
    taken = first.filter("keyed").select("file", "kind", F.col("entry").alias("number"))
    left = _ranked(entries.select("file", "kind", "number", value).join(taken, ["file", "kind", "number"], "left_anti"), ["file", "kind"], "place").select("file", "kind", "place", value)
    second = rest.join(left, ["file", "kind", "place"], "left").select("file", "kind", "number", value, F.lit(False).alias("keyed"))
    return first.filter("keyed").select("file", "kind", "number", F.col("held").alias(value), "keyed").unionByName(second)


def in_order(streams: DataFrame, entries: DataFrame, value: str) -> DataFrame:
    """Stream after stream, as a reader of the file does: its key's first free entry, else the first free one, even if a later stream has its key.

    A fold over a file's streams of a kind, of which a container numbers at most 127; columns as in keyed_first.
    """
    listed = lambda rows, *more: rows.groupBy("file", "kind").agg(F.array_sort(F.collect_list(F.struct("number", "key", *more))).alias("list"))
    mine = listed(streams).withColumnRenamed("list", "streams")
    theirs = listed(entries, F.col(value).alias("value")).withColumnRenamed("list", "entries")
    both = mine.join(theirs, ["file", "kind"], "left").withColumn("entries", F.coalesce("entries", F.array().cast(theirs.schema["entries"].dataType)))
    kind = theirs.schema["entries"].dataType.elementType.simpleString()
    out = f"struct<number:{streams.schema['number'].dataType.simpleString()},entry:{kind},keyed:boolean>"
    zero = F.struct(F.col("entries").alias("free"), F.array().cast(f"array<{out}>").alias("done"))

    def step(state, stream):
        fits = F.get(F.filter(state["free"], lambda e: (e["key"] == stream["key"]) & (e["key"] != "")), F.lit(0))
        one = F.coalesce(fits, F.get(state["free"], F.lit(0)))
        rest = F.filter(state["free"], lambda e: ~e["number"].eqNullSafe(one["number"]))
        return F.struct(rest.alias("free"), F.concat(state["done"], F.array(F.struct(stream["number"].alias("number"), one.alias("entry"), fits.isNotNull().alias("keyed")).cast(out))).alias("done"))

    done = F.aggregate("streams", zero, step)["done"]
    return both.select("file", "kind", F.explode(done).alias("x")).select("file", "kind", "x.number", F.col("x.entry.value").alias(value), "x.keyed")
