"""N-gram Jaccard join: word shingles, rare-first prefixes with length, positional and suffix filters, one verification.

1. Every document's distinct shingles are counted over the corpus by a packed exchange, which returns only those that
   occur in two documents or more; the others can't be shared. Shingles are ordered by (frequency, hash), so these come
   after the document's unique ones, and a prefix that holds unique ones alone makes the document a class of its own.
2. Documents with equal sets collapse into one class, named by its first row.
3. Classes meet on prefix shingles under the length, positional and suffix filters. The suffix
   filter splits the shingles at 1023 fixed pivots: in each part where two sets' numbers of shingles differ in parity
   stands a shingle that one of them lacks, so the parts that differ bound the Hamming distance from below.
   First come enough links for the components (spanning_links): each class is verified
   against one partner per round, linked classes get one label, a shingle whose classes all share a label is done, and an
   equi-join on prefix shingles has the pairs of different labels only, without those that a round has rejected.
4. Links become components by stars over distributed links.
5. All links lie within components, so each component's classes are dealt into blocks and meet block by block: a tile (i, j) joins
   two blocks on their prefix shingles, under the same filters, and verifies every pair that is left once (tiled). Tiles answer
   with numbers of links per class, so a group of near copies makes no row per pair (grouped_documents); linked_classes has
   the pairs themselves. A document's links are the other rows of its class and all rows of the classes that its class links with.

A tile's blocks have about BLOCK_SETS classes and BLOCK_SHINGLES shingles each (one set alone may have more), whatever the
component's size. A component of b blocks sends each of its classes to b tiles; for one of millions of different texts that
is the larger part of the exchange. representatives() needs the components alone and stops at step 4.

Sets are compared by 64-bit shingle hashes, not by their words: two different shingles of one pair of sets share a hash
with a chance of |a| * |b| / 2**64.

Two documents link when 100 * common >= percent * union. Defined results: a document without words (null, empty, or
white space) has an empty set and its own component; null doc_ids get the smallest id of their component, or null;
repeated rows and equal ids are kept and link by their sets; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, gather, only, pieces, release, spread, with_text
from reelframe.llm.components import components
from reelframe.llm.exchange import ROW, Answer, answered, batch_of, bucket_rows, buckets_for, chunk_name, from_planes, homed, planes, unpack
from reelframe.llm.textstats import Words, mix, salted, windows

SHINGLE = 5
PERCENT = 80
#: Shingles of a chunk; a task with more begins another chunk.
CHUNK = 2_000_000
ROUNDS = 2
#: Classes and shingles of a block of a component.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 20
#: 64-bit words of the parity bits of a set.
_WORDS = 16
#: Prefix shingles that a prefix row carries along from before its own, so that a pair isn't found at each of them again.
_BEFORE = 4
#: What a class carries along with each prefix shingle.
CARRIED = ["cid", "n", "first", *(f"w{k}" for k in range(_WORDS))]
DOCUMENTS = "row long, doc_id long, n_shingles long, high long, low long, shared array<long>, prefix array<long>, first long, parity array<long>"


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, by row and then hash."""
    hashes = words.hashes(True)
    at, value = windows(words, hashes, size)
    doc = words.doc[at]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < size))
    if len(short):
        held = gather(words.first[short], words.per_doc[short])
        place = held - np.repeat(words.first[short], words.per_doc[short])
        whole = np.add.reduceat(mix(hashes[held] + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), np.cumsum(words.per_doc[short]) - words.per_doc[short])
        value, doc = np.concatenate([value, mix(whole + words.per_doc[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def _pack(buckets: int, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[np.ndarray] = []
        total, documents, number = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = chunk_name(number)
            value, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(value, kind="stable")
            value, doc = value[order], doc[order].astype(np.uint16 if documents < 1 << 16 else np.uint32)
            yield batch_of([(chunk, -1, np.concatenate(ids).tobytes(), b"", b"")])
            out = bucket_rows(chunk, buckets, value, doc)
            for i in range(0, len(out), 64):
                yield batch_of(out[i : i + 64])

        for batch in pieces(batches):
            words = Words(batch.column("text"))
            value, doc = shingle_sets(words, size)
            count = np.bincount(doc, minlength=words.n)
            bounds = np.cumsum(count) - count
            full = lambda salt: np.append(mix(value ^ np.uint64(salt)), np.uint64(0))  # noqa: E731, B023
            sums = [np.where(count > 0, np.add.reduceat(full(salt), bounds), 0) if words.n else np.empty(0, np.uint64) for salt in (0x51ED270B, 0x2545F4914F6CDD1D)]
            known = batch.column("doc_id")
            ids.append(np.stack([batch.column("row").to_numpy(), known.fill_null(0).to_numpy(), known.is_null().to_numpy(zero_copy_only=False).astype(np.int64), count, sums[0].astype(np.uint64).view(np.int64), sums[1].astype(np.uint64).view(np.int64)], axis=1))
            held.append((value, doc + documents))
            total, documents = total + len(value), documents + words.n
            if total >= CHUNK:
                yield from flush()
                held, ids, total, documents, number = [], [], 0, 0, number + 1
        if ids:
            yield from flush()

    return rows


def _count(rows: list[dict]) -> Iterator[Answer]:
    """To each chunk, its shingles that occur in two documents or more, with their frequency."""
    sizes = [len(r["a"]) // 8 for r in rows]
    keys = np.concatenate([from_planes(r["a"]) for r in rows])
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    frequency = counts[inverse].astype(np.uint32)
    ends = np.cumsum(sizes)
    for r, i, j in zip(rows, ends - sizes, ends, strict=True):
        shared = np.flatnonzero(frequency[i:j] > 1)
        if len(shared):
            yield r["chunk"], r["bucket"], planes(keys[i:j][shared]), _places(r)[shared].tobytes(), frequency[i:j][shared].tobytes()


def _places(row: dict) -> np.ndarray:
    """A chunk's document numbers, of two or four bytes each."""
    return unpack(row["b"], np.uint16 if len(row["b"]) * 4 == len(row["a"]) else np.uint32)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest number of common shingles that a set of n needs with any partner."""
    return -(-n * percent // 100)


def _assemble(percent: int):
    def rows(chunk: str, payload: dict, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        table = unpack(payload["a"], np.int64).reshape(-1, 6)
        n = table[:, 3]
        key = np.concatenate([np.empty(0, np.uint64), *(from_planes(r["a"]) for r in answers)])
        frequency = np.concatenate([np.empty(0, np.uint32), *(unpack(r["c"], np.uint32) for r in answers)])
        doc = np.concatenate([_places(r) for r in answers]).astype(np.int64) if answers else np.empty(0, np.int64)
        order = np.lexsort((key, frequency, doc))
        key, doc = key[order], doc[order]
        shared = np.bincount(doc, minlength=len(n))
        prefix = n - needed(n, percent) + 1 - (n - shared)
        prefix = np.where(n > 0, np.clip(prefix, 0, shared), 0)
        starts = np.cumsum(shared) - shared
        open_ = prefix > 0
        array = lambda sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(open_, sizes, 0))).astype(np.int32)), pa.array(key[gather(starts[open_], sizes[open_])].view(np.int64)))
        bits = np.zeros((len(n), _WORDS), np.uint64)
        place = key >> np.uint64(64 - _WORDS.bit_length() + 1 - 6)
        np.bitwise_xor.at(bits, (doc, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        parity = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(open_, _WORDS, 0))).astype(np.int32)), pa.array(bits[open_].ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(table[:, 0]), pa.array(table[:, 1], mask=table[:, 2] > 0), pa.array(n), pa.array(table[:, 4]), pa.array(table[:, 5]), array(shared), array(prefix), pa.array(n - shared), parity],
            ["row", "doc_id", "n_shingles", "high", "low", "shared", "prefix", "first", "parity"],
        )

    return rows


def shingled(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per document: set size, set hash, shared shingles (rare first) and how many of them are in the prefix."""
    rows = with_text(documents.withColumn("row", F.monotonically_increasing_id()), "row")
    packed = homed(rows.mapInArrow(_pack(buckets_for(documents), size), ROW))
    return checkpointed(answered(packed, _count, _assemble(percent), DOCUMENTS, spread(documents)))


def _linked(percent: int, common: Column) -> Column:
    return 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """Pairs (a, b) and whether they link by their whole sets."""
    side = lambda s: sets.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"set_{s}"))
    linked = _linked(percent, F.size(F.array_intersect("set_a", "set_b"))).alias("linked")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", linked, *more)


def _distance(a: str, b: str) -> Column:
    """At least so many shingles stand in one of two sets only: unique ones, and parity bits of shared ones that differ."""
    bits = sum((F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}"))) for k in range(1, _WORDS)), F.bit_count(F.col(f"{a}w0").bitwiseXOR(F.col(f"{b}w0"))))
    return bits + F.col(f"{a}first") + F.col(f"{b}first")


def _possible(percent: int, a: str, b: str) -> Column:
    """The length filter and the suffix filter: whether two classes' sizes and Hamming distance allow a link."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (n_a + n_b - _distance(a, b) >= 2 * _overlap(percent, n_a, n_b))


def _overlap(percent: int, n_a: Column, n_b: Column) -> Column:
    """Common shingles that a link needs."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / (100 + percent))


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of the documents that may have partners (cid, n, shared, ...), and a row per prefix shingle of each."""
    named = documents.filter(F.size("shared") > 0).groupBy("high", "low").agg(F.min("row").alias("row"))
    words = [F.get("parity", F.lit(k)).alias(f"w{k}") for k in range(_WORDS)]
    sets = checkpointed(documents.join(named.select("row"), "row", "left_semi").select(F.col("row").alias("cid"), F.col("n_shingles").alias("n"), "shared", "prefix", "first", *words))
    before = F.slice("prefix", F.greatest(F.col("place") - (_BEFORE - 1), F.lit(1)), F.least(F.col("place"), F.lit(_BEFORE))).alias("before")
    placed = sets.select(*CARRIED, "prefix", F.posexplode("prefix").alias("place", "token"))
    return sets, checkpointed(placed.select(*CARRIED, (F.col("first") + F.col("place")).alias("place"), "token", before))


def _exact(open_: DataFrame, sets: DataFrame, percent: int, tried: DataFrame | None) -> DataFrame:
    """Every link (a, b), a < b, of classes with different labels that meet in rows of _open() and aren't in tried."""
    left, right = (open_.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("label", "place", "before", *CARRIED))) for s in "ab")
    # From the first common prefix shingle on, both sets have to hold what a link needs: the positional filter.
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    differ = (F.col("a_cid") < F.col("b_cid")) & (F.col("a_label") != F.col("b_label"))
    # A row whose classes share one of the prefix shingles before has been found there.
    again = F.arrays_overlap("a_before", "b_before")
    candidates = left.join(right, "token").filter(differ & ~again & (rest >= _overlap(percent, F.col("a_n"), F.col("b_n"))) & _possible(percent, "a_", "b_"))
    pairs = candidates.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return checkpointed(_verified(pairs, sets, percent).filter("linked").select("a", "b"))


class Tile:
    """Classes of one block, or of two that meet, as flat arrays."""

    def __init__(self, parts: list[tuple[dict[str, np.ndarray], int, int]]):
        own = {n: np.concatenate([c[n][i:j] for c, i, j in parts]) for n in ("left", "cid", "n", "first", "prefix", "members", "sizes", "parity")}
        self.left, self.cid, self.n, self.first, self.prefix, self.members, self.sizes, self.parity = own.values()
        self.tokens = np.concatenate([c["tokens"][c["at"][i] : c["at"][j]] for c, i, j in parts])
        self.within = bool(parts[0][0]["within"][parts[0][1]])

    def links(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """A class and those after it (or of the other block) that it links with; both are places in the tile."""
        starts = np.cumsum(self.sizes) - self.sizes
        known, codes = np.unique(self.tokens, return_inverse=True)
        at = gather(starts, self.prefix)
        owner = np.repeat(np.arange(len(self.n)), self.prefix)
        place = self.first[owner] + at - starts[owner]
        order = np.argsort(codes[at], kind="stable")
        posted, owner, place = codes[at][order], owner[order], place[order]
        begin = np.searchsorted(posted, np.arange(len(known) + 1))
        mark = np.zeros(len(known), np.int64)
        for a in range(len(self.n)) if self.within else np.flatnonzero(self.left):
            own = codes[starts[a] : starts[a] + self.sizes[a]]
            prefix = own[: self.prefix[a]]
            size = begin[prefix + 1] - begin[prefix]
            hit = gather(begin[prefix], size)
            other = owner[hit]
            apart = np.flatnonzero(other > a if self.within else ~self.left[other])
            # A pair is met at its rarest common shingle, the first of a's prefix; the others are the same pair again.
            b, met = np.unique(other[apart], return_index=True)
            met = apart[met]
            place_a, place_b = self.first[a] + np.repeat(np.arange(len(prefix)), size)[met], place[hit[met]]
            need = -(-percent * (self.n[a] + self.n[b]) // (100 + percent))
            possible = 100 * np.minimum(self.n[a], self.n[b]) >= percent * np.maximum(self.n[a], self.n[b])
            possible &= np.minimum(self.n[a] - place_a, self.n[b] - place_b) >= need
            distance = np.bitwise_count(self.parity[b] ^ self.parity[a]).sum(1, dtype=np.int64) + self.first[a] + self.first[b]
            b = b[possible & (self.n[a] + self.n[b] - distance >= 2 * need)]
            if not len(b):
                continue
            mark[own] = 1
            common = np.add.reduceat(mark[codes[gather(starts[b], self.sizes[b])]], np.cumsum(self.sizes[b]) - self.sizes[b])
            mark[own] = 0
            b = b[100 * common >= percent * (self.n[a] + self.n[b] - common)]
            if len(b):
                yield int(a), b


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    """Tiles of rows that are sorted by root, i, j."""
    held: list[tuple[dict[str, np.ndarray], int, int]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("root", "i", "j", "left", "cid", "n", "first", "prefix", "members")}
        own["left"] = own["left"].astype(bool)
        own["tokens"] = batch.column("shared").flatten().to_numpy()
        own["sizes"] = batch.column("shared").value_lengths().to_numpy().astype(np.int64)
        own["at"] = np.append(0, np.cumsum(own["sizes"]))
        own["parity"] = batch.column("parity").flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
        own["within"] = own["i"] == own["j"]
        keys = np.stack([own["root"], own["i"], own["j"]], 1)
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for i, j in pairwise(bounds):
            key = tuple(keys[i].tolist())
            if held and key != last:
                yield Tile(held)
                held = []
            held.append((own, i, j))
            last = key
    if held:
        yield Tile(held)
    release()


def _tile_counts(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each class of a tile, the rows of the classes that it links with there."""
        for tile in _tiles(batches):
            beside = np.zeros(len(tile.n), np.int64)
            for a, b in tile.links(percent):
                beside[a] += tile.members[b].sum()
                beside[b] += tile.members[a]
            some = np.flatnonzero(beside)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(tile.cid[some]), pa.array(beside[some])], ["cid", "beside"])

    return rows


def _tile_pairs(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            for a, b in tile.links(percent):
                one, two = np.minimum(tile.cid[a], tile.cid[b]), np.maximum(tile.cid[a], tile.cid[b])
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])

    return rows


def _dealt(sets: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """A row per class and tile that it has a part in: the tile (root, i, j), whether it stands in block i, and the class."""
    named = roots.select(F.col("node").alias("cid"), "root").unionAll(roots.select(F.col("root").alias("cid"), "root").distinct())
    weights = sets.select("cid", F.size("shared").alias("size")).join(named, "cid").groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = named.join(weights.select("root", blocks.alias("blocks")), "root").join(members, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keys = met.select("cid", "members", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"))
    held = sets.select("cid", "n", "first", F.size("prefix").cast("long").alias("prefix"), "shared", F.array(*(f"w{k}" for k in range(_WORDS))).alias("parity"))
    return keys.join(held, "cid")


def tiled(sets: DataFrame, members: DataFrame, roots: DataFrame, answer, schema: str) -> DataFrame:
    """What answer makes of the tiles of all components; sets: the classes of _classes(), members: cid and its number of rows."""
    parts = spread(sets)
    dealt = _dealt(sets, members, roots).repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return checkpointed(dealt.mapInArrow(answer, schema))


def linked_classes(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every verified pair (a, b), a < b, of classes that link; documents: the rows of shingled()."""
    sets, prefixes = _classes(documents)
    roots = components(_spanning(sets, prefixes, percent))
    return tiled(sets, _members(documents).select("cid", "members"), roots, _tile_pairs(percent), "a long, b long")


def spanning_links(documents: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) of classes, enough for the same components as all links have."""
    return _spanning(*_classes(documents), percent, rounds)


def _spanning(sets: DataFrame, prefixes: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    size = sets.count()
    found: DataFrame | None = None
    tried: DataFrame | None = None
    labels = sets.select("cid", F.col("cid").alias("label"))
    open_ = _open(prefixes, labels)
    for k in range(rounds):
        pivot = open_.groupBy("token").agg(F.min_by(F.struct("label", *CARRIED), F.struct(F.xxhash64("label", F.lit(k)), F.xxhash64("cid", F.lit(k)))).alias("p"))
        pivot = pivot.select("token", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("label", *CARRIED)))
        near = open_.select("token", *(F.col(c).alias(f"o_{c}") for c in ("label", *CARRIED))).join(pivot, "token").filter((F.col("o_label") != F.col("p_label")) & _possible(percent, "o_", "p_"))
        if tried is not None:
            both = [F.least("o_cid", "p_cid") == F.col("a"), F.greatest("o_cid", "p_cid") == F.col("b")]
            near = near.join(tried, both, "left_anti")
        pairs = near.groupBy(F.col("o_cid").alias("a")).agg(F.min_by(F.struct("p_cid", "p_label"), F.xxhash64("p_label", F.lit(k))).alias("p")).select("a", F.col("p.p_cid").alias("b"), F.col("p.p_label").alias("taken"))
        checked = checkpointed(_verified(pairs, sets, percent, "taken"))
        ordered = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = ordered if tried is None else tried.unionAll(ordered)
        new = checked.filter("linked").drop("linked")
        got = new.count()
        if got:
            edges = new.select("a", "b")
            found = edges if found is None else found.unionAll(edges)
            # A class takes its partner's label, which names a class of the same component; equal labels stay safe.
            labels = checkpointed(labels.join(new.select(F.col("a").alias("cid"), "taken"), "cid", "left").select("cid", F.coalesce("taken", "label").alias("label")))
        last = k == rounds - 1 or got * 100 < size
        if last and found is not None:
            roots = components(found)
            labels = sets.select("cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("label"))
        if got or last:
            open_ = _open(prefixes, labels)
        if last:  # the exact join has the rest
            break
    rest_links = _exact(open_, sets, percent, tried)
    return rest_links if found is None else found.unionAll(rest_links)


def _open(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix rows of shingles whose classes have more than one label."""
    rows = prefixes.join(labels, "cid")
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("token")
    return checkpointed(rows.join(mixed, "token", "left_semi"))


def _members(sets: DataFrame) -> DataFrame:
    """The classes: high, low, cid, the smallest doc_id and the number of rows."""
    return sets.filter(F.size("shared") > 0).groupBy("high", "low").agg(F.min("row").alias("cid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))


def grouped_documents(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per input row: row, doc_id, n_shingles, component_id, group (a row number that names the component), n_links."""
    shingled_ = shingled(documents, size, percent)
    sets, prefixes = _classes(shingled_)
    roots = components(_spanning(sets, prefixes, percent))
    classes = checkpointed(_members(shingled_))
    beside = tiled(sets, classes.select("cid", "members"), roots, _tile_counts(percent), "cid long, beside long").groupBy("cid").agg(F.sum("beside").alias("beside"))
    counted = classes.join(beside, "cid", "left").withColumn("n_links", F.col("members") - 1 + F.coalesce("beside", F.lit(0)))
    return _grouped(shingled_, counted, roots)


def _grouped(sets: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of grouped_documents(); n_links is what classes has."""
    rooted = checkpointed(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = rooted.select("high", "low", "root", "n_links").join(least, "root").select("high", "low", "component_id", F.col("root").alias("group"), "n_links")
    own = sets.select("row", "doc_id", "n_shingles", "high", "low", (F.size("shared") > 0).alias("open"))
    out = own.filter("open").join(by_set, ["high", "low"]).select("row", "doc_id", "n_shingles", "component_id", "group", "n_links")
    alone = own.filter("not open").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("group"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def representatives(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with the smallest doc_id (the first row of it), with all its columns."""
    sets = shingled(documents, size, percent)
    found = _grouped(sets, _members(sets).withColumn("n_links", F.lit(None).cast("long")), components(spanning_links(sets, percent)))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    return only(documents, found.groupBy("group").agg(F.min_by("row", order).alias("row")))
