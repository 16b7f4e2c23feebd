"""Prefix sums and as-of lookups of long ordered lists in two levels, so that no list, however long, is one task's work.

Rows of a key have a number that gives their order, 0, 1, ... with gaps if need be. WIDTH consecutive numbers make a block; sums run within blocks, in parallel,
and over the blocks' totals, which are WIDTH times fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 14


def running(rows: DataFrame, keys: list[str], number: str, sums: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Adds for each name the sum of its expression over the rows of the same key with a smaller number."""
    own = rows.withColumn("__block", F.floor(F.col(number) / width)).withColumns({f"__{n}": F.coalesce(x, F.lit(0)) for n, x in sums.items()})
    totals = own.groupBy(*keys, "__block").agg(*(F.sum(f"__{n}").alias(f"__b_{n}") for n in sums))
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__b_{n}").over(over), F.lit(0)) for n in sums})
    inside = Window.partitionBy(*keys, "__block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({n: F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in sums})
    joined = own.join(totals, [*keys, "__block"])
    return joined.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).drop("__block", *(f"__{n}" for n in sums), *(f"__b_{n}" for n in sums))


def _last(points: DataFrame, rows: DataFrame, keys: list[str], point: str, at: str, order: list[str], value: str) -> DataFrame:
    """points with value of the last row of the key whose at is less than point (null: none)."""
    kind = rows.schema[value].dataType
    held = [c for c in points.columns if c not in keys]
    left = points.select(*keys, F.col(point).alias("__t"), F.lit(0).alias("__side"), *(F.lit(None).cast(rows.schema[c].dataType).alias(f"__o{k}") for k, c in enumerate(order)), F.lit(None).cast(kind).alias("__value"), F.struct(*held).alias("__row"))
    right = rows.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), F.col(value).alias("__value"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    over = Window.partitionBy(*keys).orderBy("__t", "__side", *(f"__o{k}" for k in range(len(order)))).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__value", F.last("__value", ignorenulls=True).over(over)).filter("__side = 0")
    return both.select(*keys, *(F.col("__row")[c].alias(c) for c in held), F.col("__value").alias(value))


def last_before(points: DataFrame, rows: DataFrame, keys: list[str], point: str, at: str, number: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """points with `found`, a struct of columns of the last row whose at is less than point; at doesn't fall as number grows.

    The block is looked up among the blocks' first rows, the row within its block.
    """
    own = rows.withColumn("__block", F.floor(F.col(number) / width))
    heads = own.groupBy(*keys, "__block").agg(F.min(at).alias("__least"))
    placed = _last(points, heads, keys, point, "__least", ["__block"], "__block")
    named = own.withColumn("found", F.struct(*columns)).select(*keys, "__block", at, number, "found")
    inside = _last(placed.filter("__block IS NOT NULL"), named, [*keys, "__block"], point, at, [number], "found")
    none = placed.filter("__block IS NULL").withColumn("found", F.lit(None).cast(named.schema["found"].dataType))
    return inside.unionByName(none).drop("__block")
