"""Tags of several sources as fields, by a table that says which field a key is and which of several values counts.

tags: file, source, seq, key, text. maps: source, key, field, rule and part, one row a key of a source; keys match whatever their case. Rules:
`first` and `last` keep the value set first or last, `join` lists the distinct values in the order in which they came, with ` / ` between.
part `position` splits `3/12`: the number goes to the field, the total, where there is one, to the field with `_Total` behind. Sources have an order: values
of an earlier source come before those of a later one. A field that keys of several rules fill follows the rule of its first
value. Keys without a row become extra fields under their own name, `first` by rule. Null and empty values, files and keys count as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(tags: DataFrame, maps: DataFrame, sources: list[str]) -> DataFrame:
    """Every value with its field: file, field, rule, extra, place (order of the source), seq, text."""
    known = maps.select("source", F.upper("key").alias("__key"), "field", "rule", "part")
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    own = tags.filter("file IS NOT NULL AND coalesce(key, '') <> '' AND coalesce(text, '') <> ''").withColumn("__key", F.upper("key"))
    joined = own.join(known, ["source", "__key"], "left").withColumn("place", F.when(place > 0, place).otherwise(len(sources) + 1).cast("int"))
    extra = F.col("field").isNull()
    left, right = (F.trim(F.split_part("text", F.lit("/"), F.lit(k))) for k in (1, 2))
    pair = lambda field, text: F.struct(field.alias("field"), text.alias("text"))
    one = pair(F.coalesce("field", "key"), F.col("text"))
    parts = F.when(F.coalesce(F.col("part") == "position", F.lit(False)), F.array(pair(F.col("field"), left), pair(F.concat("field", F.lit("_Total")), right))).otherwise(F.array(one))
    out = joined.select("file", F.coalesce("rule", F.lit("first")).alias("rule"), extra.alias("extra"), "place", "seq", F.explode(parts).alias("x"))
    return out.select("file", "x.field", "rule", "extra", "place", "seq", "x.text").filter("text <> ''")


def resolved(tags: DataFrame, maps: DataFrame, sources: list[str]) -> DataFrame:
    """file, field, text, extra: one row a field, aggregates with partial results but for the lists of `join`, which hold one file's values of one field."""
    rows = mapped(tags, maps, sources)
    distinct = rows.groupBy("file", "field", "text").agg(F.min(F.struct("place", "seq", "rule", "extra")).alias("a"), F.max(F.struct("place", "seq")).alias("z"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a.place", "a.seq", "text"))), lambda x: x["text"]), " / ")
    one = distinct.groupBy("file", "field").agg(
        F.min(F.struct("a.place", "a.seq", "text", "a.rule", "a.extra")).alias("first"), F.max(F.struct("z.place", "z.seq", "text")).alias("last"), listed.alias("all"),
    )
    text = F.when(F.col("first.rule") == "join", F.col("all")).when(F.col("first.rule") == "last", F.col("last.text")).otherwise(F.col("first.text"))
    return one.select("file", "field", text.alias("text"), F.col("first.extra").alias("extra"))
