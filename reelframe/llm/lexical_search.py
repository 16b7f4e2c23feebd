"""Ranked lexical search by a threshold-seeded join: every item's best documents, out of all documents.

A term's impact in a document is its weight times a saturated frequency, never negative; a score is a sum of impacts. So
the k-th largest impact of any of its terms bounds an item's k-th score from below. With the terms in descending order of
their largest impact, the terms at the end whose largest impacts add up to less than that bound can't lift a document into
the ranking by themselves: they are pruned, and candidates are the documents that hold one of the others.

1. Tokenise once: a row for each document with its query terms and their frequencies, checkpointed.
2. Counts of documents, terms and document frequencies; then each term's k largest impacts, stored with their documents.
3. Bounds: the k-th stored impact of each term, and, sharper, the exact scores of the documents that are stored for the
   SEEDS best terms of any item: the k-th of these also bounds an item's k-th score from below.
4. Candidates: pairs of an item and a document that holds an essential term, whose impacts of essential terms and the
   bound of all pruned terms together reach the item's bound; each is scored exactly over all terms of the item.
5. Each task keeps its k best of an item, a window over these gives the ranks. Scores equal to a bound are never pruned.

A document's terms are in its own row, so the join with the items' terms needs no exchange: tasks hold a dictionary of a
block of items, of at most BLOCK rows of item and term and BLOCK_BYTES of terms, or one item alone. That is checked: with more
items than fit, all documents are read once more for every block. Documents exchange counts of query terms and at most k rows an item
or term and task, so no term, however frequent, and no group of copies makes a large group.

Memory of a task: a piece of PIECE_BYTES of text or one text, which is tokenised in windows, and PAIRS pairs of postings and
items at once. Driver: a block of items, a document frequency and two impacts for each of its terms, a bound an item.

Rows: null texts and texts without a term are neither counted nor found. Null items have no results. Repeated documents
are ranked each, equal scores by ascending doc_id, null last, then in the order of rows; repeated items are answered each.
doc_id is read as a long. Empty tables give no rows, and columns beside the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, flat_bytes, gather, pieces

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP, SEEDS = 50, 4
BLOCK, BLOCK_BYTES = 1 << 18, 8 << 20
PAIRS, WINDOW = 1 << 20, 1 << 20
#: Separators become blanks, capitals small letters; the bytes of other letters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id and the item's distinct terms."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))).alias("terms")).withColumn("item", F.monotonically_increasing_id())


def blocks(items: DataFrame, most: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items with a term in blocks of bounded size; a block that is larger holds one item."""
    rows = items.filter(F.size("terms") > 0).withColumn("size", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)))
    n = 1
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("terms"), F.sum("size").alias("bytes"))
        if not sizes.filter((F.col("items") > 1) & ((F.col("terms") > most) | (F.col("bytes") > most_bytes))).limit(1).count():
            break
        n *= 2
    for block in range(n):
        if found := sorted(dealt.filter(F.col("block") == block).select("item", "item_id", "terms").collect(), key=lambda r: r.item):
            yield found


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a window at a time."""
    text, at = text.translate(TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + WINDOW)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def postings(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """row, doc_id, n (all terms of the text), and the known terms with their frequencies; texts with a term only."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, offsets = flat_bytes(batch.column("text"))
            flat, total, own = flat.tobytes(), np.zeros(batch.num_rows, np.int64), []
            for i in range(batch.num_rows):
                ids = []
                for part in words(flat[offsets[i] : offsets[i + 1]]):
                    total[i] += len(part)
                    ids.append(np.fromiter((terms.get(x, -1) for x in part), np.int32, len(part)))
                own.append(np.unique(np.concatenate(ids), return_counts=True) if ids else (np.empty(0, np.int32), np.empty(0, np.int64)))
            own = [(t[t >= 0], c[t >= 0]) for t, c in own]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in own])]), pa.int32())
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(total), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in own]).astype(np.int32))) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "terms", "tfs"]).filter(pa.array(total > 0))

    own = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(tokenise, "row long, doc_id long, n long, terms array<int>, tfs array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting: the place of its document in the batch, its term, its frequency."""
    sizes = np.diff(batch.column("terms").offsets.to_numpy())
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs")]
    return np.repeat(np.arange(batch.num_rows), sizes), *flat


def _counted(known: int):
    """Documents of each term; documents and terms at all as terms -1 and -2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, length, frequency = 0, 0, np.zeros(known, np.int64)
        for batch in batches:
            documents += batch.num_rows
            length += int(batch.column("n").to_numpy().sum())
            frequency += np.bincount(_flat(batch)[1], minlength=known)
        met = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], met]).astype(np.int32)), pa.array(np.concatenate([[documents, length], frequency[met]]).astype(np.int64))], names=["term", "count"])

    return count


class Scale:
    """Weights of the terms and the lengths' divisors, in 64-bit integers."""

    def __init__(self, documents: int, length: int, frequency: np.ndarray):
        self.documents, self.length = documents, length
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)

    def impacts(self, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


class Best:
    """The k entries with the highest value of each group, equal values by the smallest id and then row."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.limit = k, [], 0, 1 << 17

    def add(self, group: np.ndarray, value: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((group, value, ids, rows))
        self.held += len(group)
        if self.held > self.limit:
            self.limit = max(1 << 17, 2 * len(self.result()[0]))

    def result(self) -> tuple[np.ndarray, ...]:
        group, value, ids, rows = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64),) * 4
        order = np.lexsort((rows, ids, -value, group))
        group = group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        order = order[rank < self.k]
        self.parts, self.held = [(group[rank < self.k], value[order], ids[order], rows[order])], len(order)
        return self.parts[0]

    def batch(self, name: str) -> pa.RecordBatch:
        group, value, ids, rows = self.result()
        ids = pa.array(ids, mask=ids == NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(value), ids, pa.array(rows)], names=[name, "value", "doc_id", "row"])


NO_ID = np.iinfo(np.int64).max


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy()


def _stored(scale: Scale, k: int):
    """A task's k largest impacts of each term."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            at, terms, tfs = _flat(batch)
            n, rows = batch.column("n").to_numpy(), batch.column("row").to_numpy()
            best.add(terms, scale.impacts(terms, tfs, n[at]), _ids(batch)[at], rows[at])
        yield best.batch("term")

    return store


def top(rows: DataFrame, group: str, k: int) -> DataFrame:
    """rank and the k best rows of each group."""
    order = Window.partitionBy(group).orderBy(F.col("value").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Plan:
    """Items as ragged arrays of terms: all terms, the essential ones by term, and the bounds of both."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, items: int, highest: np.ndarray, bound: np.ndarray):
        self.bound, self.items, self.known = bound, items, len(highest)
        order = np.lexsort((term, -highest[term], owner))  # descending largest impacts within each item
        owner, term = owner[order], term[order]
        self.ptr = np.searchsorted(owner, np.arange(items + 1))
        self.terms = term
        suffix = np.cumsum(highest[term][::-1])[::-1]  # the sum of an item's terms from here to its end
        beyond = np.append(suffix, 0)[self.ptr[owner + 1]] if len(owner) else suffix
        suffix = suffix - beyond
        pruned = suffix < bound[owner]
        self.rest = np.zeros(items, np.int64)
        np.maximum.at(self.rest, owner[pruned], suffix[pruned])
        owner, term = owner[~pruned], term[~pruned]
        order = np.argsort(term, kind="stable")
        self.hit_items = owner[order]
        self.hit_ptr = np.searchsorted(term[order], np.arange(self.known + 1))


def _scored(plan: Plan, scale: Scale, k: int):
    """A task's k best documents of each item among those that reach the item's bound."""

    def candidates(at: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (document, item) in order and their sums over essential terms."""
        sizes = plan.hit_ptr[terms + 1] - plan.hit_ptr[terms]
        items = plan.hit_items[gather(plan.hit_ptr[terms], sizes)]
        keys = np.repeat(at, sizes) * plan.items + items
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], np.repeat(impact, sizes)[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(values, first) if len(first) else values

    def rescored(keys: np.ndarray, own: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores: every term of the item, looked up in the document. own: keys (document, term) in order."""
        doc, item = keys // plan.items, keys % plan.items
        sizes = plan.ptr[item + 1] - plan.ptr[item]
        wanted = np.repeat(doc, sizes) * plan.known + plan.terms[gather(plan.ptr[item], sizes)]
        place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        values = np.where(own[place] == wanted, impact[place], 0)
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else values

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            at, terms, tfs = _flat(batch)
            if not len(at):
                continue
            n, rows, ids = batch.column("n").to_numpy(), batch.column("row").to_numpy(), _ids(batch)
            impact = scale.impacts(terms, tfs, n[at])
            own = at * plan.known + terms
            work = np.cumsum(np.bincount(at, plan.hit_ptr[terms + 1] - plan.hit_ptr[terms], batch.num_rows))
            ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
            first = 0
            while first < batch.num_rows:  # documents whose pairs fit, one at least
                last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + PAIRS, "right")))
                cut = slice(ends[first], ends[last])
                keys, partial = candidates(at[cut], terms[cut], impact[cut])
                keys = keys[partial + plan.rest[keys % plan.items] >= plan.bound[keys % plan.items]]
                for part in np.array_split(keys, max(1, -(-len(keys) * max(1, len(plan.terms) // max(1, plan.items)) // PAIRS))):
                    value = rescored(part, own, impact)
                    good = value >= np.maximum(plan.bound[part % plan.items], 1)
                    doc, item = part[good] // plan.items, part[good] % plan.items
                    best.add(item, value[good], ids[doc], rows[doc])
                first = last
        yield best.batch("item")

    return score


def _block(documents: DataFrame, items: list, kind: str, k: int, seeds: int) -> DataFrame:
    spark = documents.sparkSession
    names = sorted({t for r in items for t in r.terms})
    number = {t: i for i, t in enumerate(names)}
    owner = np.repeat(np.arange(len(items)), [len(r.terms) for r in items])
    term = np.fromiter((number[t] for r in items for t in r.terms), np.int64, len(owner))

    held = checkpointed(postings(documents, {t.encode(): i for t, i in number.items()}))
    counts = {r.term: r.n for r in held.mapInArrow(_counted(len(names)), "term int, count long").groupBy("term").agg(F.sum("count").alias("n")).collect()}
    scale = Scale(counts.get(-1, 0), counts.get(-2, 0), np.array([counts.get(i, 0) for i in range(len(names))], np.int64))

    stored = checkpointed(top(held.mapInArrow(_stored(scale, k), "term int, value long, doc_id long, row long"), "term", k).select("term", "value", "row"))
    kth, highest = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for r in stored.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).collect():
        kth[r.term], highest[r.term] = r.least if r.n >= k else 0, r.most
    bound = np.zeros(len(items), np.int64)
    np.maximum.at(bound, owner, kth[term])

    chosen = set()
    for i in range(len(items)):
        own = term[owner == i] if len(items) < 64 else term[slice(*np.searchsorted(owner, (i, i + 1)))]
        chosen.update(own[np.lexsort((own, -kth[own]))[:seeds]].tolist())
    ids = spark.createDataFrame([(int(t),) for t in chosen], "term int")
    rows = stored.join(ids, "term", "left_semi").select("row").distinct()
    schema = "item int, value long, doc_id long, row long"
    seeded = top(held.join(rows, "row", "left_semi").mapInArrow(_scored(Plan(owner, term, len(items), highest, bound), scale, k), schema), "item", k)
    for r in seeded.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).filter(F.col("n") >= k).collect():
        bound[r.item] = max(bound[r.item], r.least)

    found = top(held.mapInArrow(_scored(Plan(owner, term, len(items), highest, bound), scale, k), schema), "item", k)
    given = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], f"item int, item_id {kind}")
    return found.join(given, "item").select("item_id", "rank", "doc_id", F.col("value").alias("score"))


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP, seeds: int = SEEDS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0."""
    kind = dict(items.dtypes)["item_id"]
    out = documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for own in blocks(item_terms(items), block, block_bytes):
        out = out.unionByName(_block(documents, own, kind, k, seeds))
    return out


def oracle_sql(k: int = TOP) -> str:
    """Every score in DuckDB's SQL, for tables with one row per id."""
    found = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {found} AS words FROM documents WHERE len({found}) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS length FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) SEMI JOIN q USING (term) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS impact FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r) WHERE rank <= {k}"""
