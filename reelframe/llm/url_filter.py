"""URL filters as a sort-merge range join of page urls with a table of host and path rules.

A url's canonical key is its host with the labels reversed, each followed by a dot, and then its path
(`example.org/en/1` is `org.example./en/1`). A rule covers the interval of all keys that begin with its own key, and two
such intervals are nested or apart. A rule fits subdomains too, at any path, so a url enters the sort once for each
parent host that rules can have (`org./en/1`, `org.example./en/1`): from the fewest to the most labels of a rule's host.

Keys are cut into ranges at quantiles of a sample, as a range exchange does. Rows of one key have a hash as a second sort
column, so a key that a third of all pages share spreads over many ranges. A rule goes to every range that its
interval meets: at most once a range for each rule that is nested in it, and once besides. Within a range, rows are sorted and
swept once: a stack holds the rules that are open at the current key, the innermost on top, and nothing else is kept.
The longest of the innermost rules of a url's keys wins.

Driver: SAMPLE keys a task, of at most KEY characters each, and the fewest and most labels of the rules' hosts. These
bounds go to the tasks; the rules are never broadcast.

Rows: null urls, and those without `://`, have an empty host and path; such pages and those that no rule fits get
`otherwise`. Repeated pages are judged each. Rules: null hosts and paths are empty, A-Z of hosts is lower-cased, an empty
host fits every url, a path that neither is empty nor begins with `/` fits none. Of rules with equal length the one with the longer
host wins; of one rule with two verdicts, `block`. Empty tables of pages or rules, and columns beside the named ones, are fine.
Keys are compared whole, however long; a row, with its url, has to fit into an Arrow batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled pages for each task, and the characters of a key that a bound of a range has.
SAMPLE, KEY = 40, 200
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RULE = "rule string, verdict string, n int, h int"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), UPPER, LOWER), F.regexp_extract(text, _PARTS, 2)


def _labels(host: Column) -> Column:
    """Labels from the last to the first; none of an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.", -1)))


def _key(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("."))), "")


def canonical(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict, n, h), one row a rule: its key, its text, its verdict and the lengths of text and host."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host")
    own = rules.select(host, F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("path = '' OR path LIKE '/%'")
    one = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return one.select(F.concat(_key(_labels(F.col("host"))), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.size(_labels(F.col("host"))).alias("labels"))


def points(pages: DataFrame, least: int, most: int) -> DataFrame:
    """A row for each page and each of its hosts that a rule can have, one at least; the first one carries the page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = _labels(F.col("host"))
    keys = F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.size(labels), F.lit(most)))), lambda i: F.concat(_key(F.slice(labels, 1, i)), "path"))
    spread_out = rows.select("row", "page_id", "host", "path", F.posexplode(keys).alias("at", "key"))
    mine = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    return spread_out.select("row", mine("page_id"), mine("host"), mine("path"), "key", F.xxhash64("row", "at").alias("salt"), (F.col("at") == 0).alias("first"))


def bounds(rows: DataFrame, pages: int, parts: int) -> list[tuple[str, int]]:
    """The first (key, salt) of every range but the first, from a sample by hash."""
    most = 1 << 40
    wanted = most if pages <= SAMPLE * parts else max(1, most * SAMPLE * parts // pages)
    seen = sorted((r.key, r.salt) for r in rows.filter(F.pmod("salt", F.lit(most)) < wanted).select(F.substring("key", 1, KEY).alias("key"), "salt").collect())
    return sorted({seen[len(seen) * k // parts] for k in range(1, parts)}) if seen else []


def _dealt(ends: list[tuple[str, int]]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(ends, (k[:KEY], s)) for k, s in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "part"])

    return deal


def _replicated(ends: list[tuple[str, int]]):
    """Rules go to each range that holds a key which begins with theirs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, at = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                key = key[:KEY]
                part = bisect_left(ends, (key,))
                source.append(i)
                at.append(part)
                while part < len(ends) and ends[part][0].startswith(key):
                    part += 1
                    source.append(i)
                    at.append(part)
            taken = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32())], names=[*taken.schema.names, "part"])

    return deal


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of the sorted rows with the innermost rule that is open at their key."""
    stack: list[tuple[str, tuple]] = []
    for batch in batches:
        given = [batch.column(c).to_pylist() for c in ("key", "rule", "verdict", "n", "h", "first")]
        kept, found = [], []
        for i, (key, rule, verdict, n, h, first) in enumerate(zip(*given, strict=True)):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, (rule, verdict, n, h)))
            elif stack or first:
                kept.append(i)
                found.append(stack[-1][1] if stack else (None, None, None, None))
        own = batch.select(["row", "page_id", "host", "path"]).take(pa.array(kept, pa.int64()))
        more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*own.columns, *more], names=["row", "page_id", "host", "path", "rule", "verdict", "n", "h"])


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each page; pages: page_id, url; rules: host, path, verdict."""
    own = canonical(rules)
    span = own.agg(F.min("labels"), F.max("labels")).first()
    least, most = (0, 0) if span[0] is None else (span[0], span[1])
    rows = points(pages, least, most)
    parts = spread(pages)
    ends = bounds(rows, pages.count(), parts)
    part = "part int"
    kinds = dict(rows.dtypes)
    dealt = rows.mapInArrow(_dealt(ends), ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + f", {part}")
    opened = own.drop("labels").mapInArrow(_replicated(ends), f"key string, {_RULE}, {part}")
    both = dealt.unionByName(opened, allowMissingColumns=True).withColumn("first", F.coalesce("first", F.lit(False)))
    swept = both.repartitionById(parts, F.col("part")).sortWithinPartitions("key", F.col("rule").isNull(), "salt")
    hits = swept.mapInArrow(_sweep, f"row long, page_id {kinds['page_id']}, host string, path string, {_RULE}")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("n", "h", "rule", "verdict"))).alias("best")
    out = hits.groupBy("row").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def oracle_sql(rules: list[tuple[str, str, str]], otherwise: str = "allow") -> str:
    """The same verdicts in DuckDB's SQL, for tables with one row per page_id."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {values}) AS v(host, path, verdict)),
f AS (SELECT page_id, arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, 1000000 * length(r.host || r.path) + length(r.host)) AS best
 FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, '{otherwise}') AS verdict FROM p LEFT JOIN f USING (page_id)"""
