"""Suffix-array dedup: every byte under a string of LENGTH bytes that starts at another place too is removed.

1. Each text is cut into runs of neighbouring LENGTH-byte suffix prefixes that share a minimizer (the place of the
   first least hash of ANCHOR bytes in them), so equal strings lie in runs with equal minimizers. A packed exchange tells which whole runs
   occur again, and which minimizers stand in different runs. Of the latter, the runs that don't recur as a whole and
   one copy of each that does go on; all other text is settled.
2. The suffixes of those runs are sorted within a chunk: prefix polynomial hashes and a binary search give the common
   extension of two suffixes, so a comparison takes log LENGTH steps, in a bottom-up mergesort over all buckets of equal
   first bytes at once. Neighbours whose extension reaches LENGTH are compared byte by byte, so that no hash collision
   counts as a match. Each distinct prefix then meets those of other chunks under two independent 64-bit hashes.
3. The covered bytes of a text are the union of its recurring runs and prefixes.

Runs that recur as a whole are told by three 64-bit hashes together, the minimizer's and two of the run's text with
byte values and bases of their own; their bytes are not compared.

A minimizer sends at most two distinct runs per chunk (a third makes all of them go on), and a prefix one entry, so a
passage that very many documents share is no hot group. Long texts are read in windows of PIECE bytes and their runs
are dealt to chunks of CHUNK_BYTES, so a task holds a long text itself and temporaries of a fixed size.

Defined results: a null or empty text has no bytes and no spans; texts under LENGTH bytes keep all; repeated rows cover
each other; null doc_ids are kept; other columns are ignored; an empty table gives an empty result. The table has to be
the same whenever it is read (a file scan or a checkpoint), because texts are joined to their spans by row number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, flat_bytes, gather, numbered, pieces, release, spread, with_text
from reelframe.llm.exchange import ROW, Answer, answered, batch_of, bucket_of, bucket_rows, buckets_for, chunk_name, from_planes, homed, unpack
from reelframe.llm.textstats import prefix_hashes, second_prefix_hashes, second_span_hashes, span_hashes

LENGTH = 200
ANCHOR = 100
#: Runs, and bytes of sorted text, after which a task begins another chunk.
CHUNK_RUNS = 1_000_000
CHUNK_BYTES = 3 << 20
#: Text bytes whose minimizers are found at once.
PIECE = 1 << 20
_BUCKET = 24
_UNSENT = (1 << 32) - 1
_TAIL = np.dtype([("second", np.uint64), ("flags", np.uint8)])
_NOTHING = hashlib.sha256(b"").hexdigest()


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each window of width values."""
    count = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    place = np.arange(padded.size).reshape(padded.shape)
    least = np.minimum.accumulate(padded, 1)
    fresh = np.ones(padded.shape, bool)
    fresh[:, 1:] = padded[:, 1:] < least[:, :-1]
    ahead, ahead_at = least.ravel(), np.maximum.accumulate(np.where(fresh, place, -1), 1).ravel()
    flipped = padded[:, ::-1]
    least = np.minimum.accumulate(flipped, 1)
    fresh[:, 1:] = flipped[:, 1:] <= least[:, :-1]
    behind_at = np.minimum.accumulate(np.where(fresh, place[:, ::-1], padded.size), 1)[:, ::-1].ravel()
    behind = least[:, ::-1].ravel()
    first, last = slice(0, count), slice(width - 1, width - 1 + count)
    return np.where(behind[first] <= ahead[last], behind_at[first], ahead_at[last])


def runs(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, window: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of all runs: first place, number of suffixes, row, minimizer, and two hashes of the run's whole text.

    Suffixes are taken in windows; a run that a window's end cuts goes on as another run of the same minimizer.
    """
    none = np.empty(0, np.int64)
    found = [(none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64))]
    for at in range(0, max(len(flat) - length + 1, 0), window):
        own = _window_runs(flat[at : at + window + length - 1], offsets - at, length, anchor)
        found.append((own[0] + at, *own[1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _window_runs(flat: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    prefix = prefix_hashes(flat)
    place = np.arange(len(flat) - anchor + 1)
    grams = span_hashes(prefix, place, place + anchor)
    width = length - anchor + 1
    count = len(grams) - width + 1
    anchor_at = _leftmost_minima(grams, width)
    doc = np.searchsorted(offsets, np.arange(count), "right") - 1
    inside = np.arange(count) + length <= offsets[1:][doc]
    new = np.ones(count, bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    sizes = np.add.reduceat(inside.astype(np.int64), heads)
    used = sizes > 0
    heads, sizes = heads[used], sizes[used]
    ends = heads + sizes + length - 1
    return heads, sizes, doc[heads], grams[anchor_at[heads]], span_hashes(prefix, heads, ends), second_span_hashes(second_prefix_hashes(flat), heads, ends)


def _pack_runs(buckets: int, length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        tables: list[np.ndarray] = []
        shas: list[bytes] = []
        total, documents, number = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = chunk_name(number)
            sizes, doc, least, whole, other = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((other, whole, least))
            a, b, c = least[order], whole[order], other[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            entry_of_sorted = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            key, run, second, again = a[firsts], b[firsts], c[firsts], np.diff(np.append(firsts, len(a))) > 1
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            tail = np.append(head[1:], True) if len(key) else head
            sent = head | tail  # at most two distinct runs of a minimizer
            group = np.cumsum(head) - 1
            more = (np.bincount(group) > 2)[group] if len(key) else head
            entry = np.empty(len(a), np.uint32)
            entry[order] = np.where(sent, np.cumsum(sent) - 1, _UNSENT).astype(np.uint32)[entry_of_sorted] if len(key) else entry
            flags = again[sent].astype(np.uint8) | more[sent].astype(np.uint8) << np.uint8(1)
            texts = np.concatenate(tables)
            # A text's runs follow each other without gaps, so their sizes say where each begins.
            counts = np.bincount(doc, minlength=len(texts))
            firsts_of = np.searchsorted(bucket_of(key[sent], buckets), np.arange(buckets))
            head_ = np.concatenate([[len(texts)], np.column_stack([texts, counts]).ravel(), firsts_of]).astype(np.int64)
            yield batch_of([(chunk, -1, head_.tobytes(), sizes.astype(np.uint8).tobytes() + entry.tobytes(), b"".join(shas))])
            tail_ = np.empty(len(flags), _TAIL)
            tail_["second"], tail_["flags"] = second[sent], flags
            out = bucket_rows(chunk, buckets, key[sent], run[sent], tail_)
            for i in range(0, len(out), 64):
                yield batch_of(out[i : i + 64])

        for batch in pieces(batches, limit=PIECE):
            flat, offsets = flat_bytes(batch.column("text"))
            starts, sizes, doc, least, whole, other = runs(flat, offsets, length)
            known = batch.column("doc_id")
            tables.append(np.stack([batch.column("row").to_numpy(), known.fill_null(0).to_numpy(), known.is_null().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)], 1))
            view = memoryview(np.ascontiguousarray(flat))
            shas += [hashlib.sha256(view[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            held.append((sizes.astype(np.int32), (doc + documents).astype(np.int32), least, whole, other))
            total, documents = total + len(sizes), documents + len(offsets) - 1
            if total >= CHUNK_RUNS:
                yield from flush()
                held, tables, shas, total, documents, number = [], [], [], 0, 0, number + 1
        if tables:
            yield from flush()

    return rows


def _judge_runs(rows: list[dict]) -> Iterator[Answer]:
    """Code of each run: 1 goes on, 2 recurs as a whole, 3 both (the first copy of one that recurs)."""
    sizes = [len(r["a"]) // 8 for r in rows]
    key = np.concatenate([from_planes(r["a"]) for r in rows])
    run, tail = (np.concatenate([unpack(r[n], t) for r in rows]) for n, t in (("b", np.uint64), ("c", _TAIL)))
    order = np.lexsort((tail["second"], run, key))
    a, b, c, f = key[order], run[order], tail["second"][order], tail["flags"][order]
    new_key = np.ones(len(a), bool)
    new_key[1:] = a[1:] != a[:-1]
    new = new_key.copy()
    new[1:] |= (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    pair, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    again = (np.bincount(pair) > 1) | (np.bincount(pair, weights=f & 1) > 0)
    mixed = (np.bincount(group[new]) > 1) | (np.bincount(group, weights=f & 2) > 0)
    code = np.where(again[pair], np.where(mixed[group] & new, 3, 2), np.where(mixed[group], 1, 0)).astype(np.uint8)
    out = np.empty(len(code), np.uint8)
    out[order] = code
    ends = np.cumsum(sizes)
    for r, i, j in zip(rows, ends - sizes, ends, strict=True):
        if (told := np.flatnonzero(out[i:j])).size:
            yield r["chunk"], r["bucket"], out[i:j][told].tobytes(), told.astype(np.uint32).tobytes(), b""


MARKED = "row long, doc_id long, n_bytes long, sha256 string, starts array<long>, sizes array<int>, codes array<int>, deep boolean"


def _mark(chunk: str, payload: dict, answers: list[dict]) -> Iterator[pa.RecordBatch]:
    head = unpack(payload["a"], np.int64)
    texts, first_entry = head[1 : 1 + 5 * head[0]].reshape(-1, 5), head[1 + 5 * head[0] :]
    raw, sha = payload["b"], payload["c"]
    total = len(raw) // 5
    size, entry = unpack(raw[:total], np.uint8).astype(np.int64), unpack(raw[total:], np.uint32).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), texts[:, 4])
    start = np.cumsum(size) - size
    start = start - np.repeat(start[np.minimum(np.cumsum(texts[:, 4]) - texts[:, 4], total - 1)], texts[:, 4]) if total else start
    code_of = np.zeros(int(entry[entry != _UNSENT].max(initial=-1)) + 1, np.uint8)
    for r in answers:
        code_of[first_entry[r["bucket"]] + unpack(r["b"], np.uint32)] = unpack(r["a"], np.uint8)
    code = np.ones(total, np.uint8)  # runs that weren't sent go on
    code[entry != _UNSENT] = code_of[entry[entry != _UNSENT]]
    threes = np.flatnonzero(code == 3)  # one copy is enough
    if len(threes):
        _, first = np.unique(entry[threes], return_index=True)
        code[threes] = 2
        code[threes[first]] = 3
    used = code > 0
    doc, starts, sizes, code = text_of[used], start[used], size[used], code[used]
    counts = np.bincount(doc, minlength=len(texts))
    bounds = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    deep = np.bincount(doc, weights=code != 2, minlength=len(texts)) > 0
    array = lambda x, t: pa.ListArray.from_arrays(bounds, pa.array(x.astype(t)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(texts[:, 0]), pa.array(texts[:, 1], mask=texts[:, 2] > 0), pa.array(texts[:, 3]), pa.array([sha[i : i + 32].hex() for i in range(0, len(sha), 32)], pa.string()), array(starts, np.int64), array(sizes, np.int32), array(code, np.int32), pa.array(deep)],
        [x.split()[0] for x in MARKED.split(", ")],
    )


class Suffixes:
    """Suffixes of a flat text, compared by their first length bytes."""

    def __init__(self, flat: np.ndarray, length: int = LENGTH):
        self.flat, self.length = flat, length
        self.prefix = prefix_hashes(flat)
        self.steps = [1 << k for k in range((length - 1).bit_length() - 1, -1, -1)]
        self.whole = span_hashes(self.prefix, *(np.arange(max(len(flat) - length + 1, 0)) + x for x in (0, length)))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of two suffixes, by binary search over prefix hashes; length where all agree."""
        size = np.full(len(i), self.length)
        differ = np.flatnonzero(self.whole[i] != self.whole[j])
        i, j = i[differ], j[differ]
        own = np.zeros(len(i), np.int64)
        for step in self.steps:
            more = np.minimum(own + step, self.length - 1)
            own = np.where(span_hashes(self.prefix, i, i + more) == span_hashes(self.prefix, j, j + more), more, own)
        size[differ] = own
        return size

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = self.common(i, j)
        last = self.length - 1
        at = np.minimum(size, last)
        return (size < self.length) & (self.flat[i + at] < self.flat[j + at])

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the first length bytes agree: by hashes, then verified byte by byte."""
        same = self.whole[i] == self.whole[j]
        words = np.ndarray(max(len(self.flat) - 7, 0), np.uint64, self.flat, strides=(1,)) if self.length >= 8 else self.flat
        size = words.itemsize
        at = np.flatnonzero(same)
        for k in [*range(0, self.length - size, size), self.length - size]:
            agree = words[i[at] + k] == words[j[at] + k]
            same[at[~agree]] = False
            at = at[agree]
        return same

    def sort(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the places by (bucket of first bytes, suffix), and each bucket's number in that order."""
        bucket = span_hashes(self.prefix, places, places + _BUCKET)
        order = np.argsort(bucket, kind="stable")
        _, group = np.unique(bucket[order], return_inverse=True)
        first = np.searchsorted(group, np.arange(group[-1] + 1 if len(group) else 0))
        size = np.diff(np.append(first, len(order)))
        width, current = 1, places[order]
        local = np.arange(len(order)) - first[group]
        while len(size) and width < size.max():
            active = np.flatnonzero(size[group] > width)
            base = first[group[active]]
            mine = local[active] // width
            other = mine ^ 1
            low = base + other * width
            high = np.minimum(low + width, base + size[group[active]])
            alone = low >= high
            low, high = np.where(alone, 0, low), np.where(alone, 0, high)
            start = low.copy()
            item = current[active]
            right = mine % 2 == 1
            while (open_ := np.flatnonzero(low < high)).size:  # place among the sibling run; the left one goes first on ties
                middle = (low[open_] + high[open_]) // 2
                there = current[middle]
                r = right[open_]
                before = np.where(r, ~self.less(item[open_], there), False)
                if (~r).any():
                    left = np.flatnonzero(~r)
                    before[left] = self.less(there[left], item[open_][left])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            rank = np.where(alone, 0, low - start)
            pair = base + (mine // 2) * 2 * width
            target = pair + local[active] % width + rank
            merged = current.copy()
            merged[target] = item
            back = order.copy()
            back[target] = order[active]
            current, order, width = merged, back, 2 * width
        return order, group

    def classes(self, places: np.ndarray) -> np.ndarray:
        """A number per place, equal where the first length bytes are."""
        order, group = self.sort(places)
        out = np.empty(len(places), np.int64)
        if len(places):
            sorted_ = places[order]
            new = np.ones(len(places), bool)
            together = np.flatnonzero(group[1:] == group[:-1])
            new[together + 1] = ~self.equal(sorted_[together], sorted_[together + 1])
            out[order] = np.cumsum(new) - 1
        return out


def _pack_prefixes(buckets: int, length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []
        total, number = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = chunk_name(number)
            flat = np.ascontiguousarray(np.concatenate(segments))
            row, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
            at = np.cumsum(size + length - 1) - (size + length - 1)
            places = gather(at, size)
            suffixes = Suffixes(flat, length)
            kind = suffixes.classes(places)
            _, first, count = np.unique(kind, return_index=True, return_counts=True)
            key = span_hashes(suffixes.prefix, places[first], places[first] + length)
            other = second_span_hashes(second_prefix_hashes(flat), places[first], places[first] + length)
            order = np.lexsort((other, key))
            named = order.astype(np.uint32) | (count[order] > 1).astype(np.uint32) << np.uint32(31)
            yield batch_of([(chunk, -1, np.stack([row, start, size], 1).astype(np.int64).tobytes(), kind.astype(np.uint32).tobytes(), b"")])
            out = bucket_rows(chunk, buckets, key[order], other[order], named)
            for i in range(0, len(out), 64):
                yield batch_of(out[i : i + 64])

        for batch in pieces(batches):
            flat, offsets = flat_bytes(batch.column("text"))
            bounds = batch.column("starts").offsets.to_numpy()
            starts, sizes, codes = (batch.column(n).values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64) for n in ("starts", "sizes", "codes"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            on = codes != 2
            doc, starts, sizes = doc[on], starts[on], sizes[on]
            row, place = batch.column("row").to_numpy()[doc], offsets[:-1][doc] + starts
            ends, first = np.cumsum(sizes + length - 1), 0
            while first < len(sizes):  # a chunk takes as many runs as it has room for
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + CHUNK_BYTES - total, "right")))
                segments.append(flat[gather(place[first:last], sizes[first:last] + length - 1)])
                found.append((row[first:last], starts[first:last], sizes[first:last]))
                total, first = total + len(segments[-1]), last
                if total >= CHUNK_BYTES or first < len(sizes):
                    yield from flush()
                    segments, found, total, number = [], [], 0, number + 1
        if total:
            yield from flush()

    return rows


def _judge_prefixes(rows: list[dict]) -> Iterator[Answer]:
    """To each chunk, which of its distinct prefixes recur, in it or in another."""
    sizes = [len(r["a"]) // 8 for r in rows]
    key = np.concatenate([from_planes(r["a"]) for r in rows])
    other, named = (np.concatenate([unpack(r[n], t) for r in rows]) for n, t in (("b", np.uint64), ("c", np.uint32)))
    order = np.lexsort((other, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
    pair = np.empty(len(key), np.int64)
    pair[order] = np.cumsum(new) - 1
    again = (np.bincount(pair) > 1)[pair] | (named >> np.uint32(31) > 0)
    ends = np.cumsum(sizes)
    for r, i, j in zip(rows, ends - sizes, ends, strict=True):
        if again[i:j].any():
            yield r["chunk"], r["bucket"], (named[i:j][again[i:j]] & np.uint32((1 << 31) - 1)).tobytes(), b"", b""


def _cover(chunk: str, payload: dict, answers: list[dict]) -> Iterator[pa.RecordBatch]:
    row, start, size = unpack(payload["a"], np.int64).reshape(-1, 3).T
    kind = unpack(payload["b"], np.uint32)
    again = np.zeros(int(kind.max(initial=0)) + 1, bool)
    for r in answers:
        again[unpack(r["a"], np.uint32)] = True
    hit = np.flatnonzero(again[kind])
    owner = np.repeat(np.arange(len(size)), size)[hit]
    place = gather(start, size)[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    yield pa.RecordBatch.from_arrays([pa.array(row[owner[heads]]), pa.array(place[heads]), pa.array(np.diff(np.append(heads, len(hit))).astype(np.int32))], ["row", "start", "size"])


SPANS = "row long, doc_id long, n_bytes long, sha256 string, spans array<struct<start: long, stop: long>>"


def _united(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The recurring runs and prefixes of each row, sorted, with those that meet or overlap joined to one span."""
        for batch in batches:
            parts = []
            for names in (("starts", "sizes"), ("found_starts", "found_sizes")):
                lists = [batch.column(n) for n in names]
                owner = pa.compute.list_parent_indices(lists[0]).to_numpy()
                parts.append((owner.astype(np.int64), *(x.flatten().to_numpy().astype(np.int64) for x in lists)))
            codes = batch.column("codes").flatten().to_numpy()
            parts[0] = tuple(x[codes >= 2] for x in parts[0])
            owner, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, owner))
            owner, start, stop = owner[order], start[order], (start + size)[order] + length - 1
            shift = owner * (int(stop.max(initial=0)) + 2)  # rows stay apart
            reach = np.maximum.accumulate(stop + shift) if len(stop) else stop
            new = np.ones(len(start), bool)
            new[1:] = start[1:] + shift[1:] > reach[:-1]
            heads = np.flatnonzero(new)
            lasts = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
            bounds = pa.array(np.searchsorted(owner[heads], np.arange(batch.num_rows + 1)).astype(np.int32))
            spans_ = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(start[heads]), pa.array(reach[lasts] - shift[heads])], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "doc_id", "n_bytes", "sha256")), spans_], ["row", "doc_id", "n_bytes", "sha256", "spans"])
        release()

    return rows


def spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per document: row, doc_id, n_bytes, sha256 of the whole text, spans (removed runs: start, stop in bytes)."""
    rows = with_text(documents.withColumn("row", F.monotonically_increasing_id()), "row")
    parts, buckets = spread(documents), buckets_for(documents)
    marked = checkpointed(answered(homed(rows.mapInArrow(_pack_runs(buckets, length), ROW)), _judge_runs, _mark, MARKED, parts))
    deep = marked.filter("deep").select("row", "starts", "sizes", "codes")
    sorted_ = homed(rows.select("row", "text").join(deep, "row").mapInArrow(_pack_prefixes(buckets, length), ROW))
    found = answered(sorted_, _judge_prefixes, _cover, "row long, start long, size int", parts)
    # A document's covered places, at most one entry per place: no longer than its text.
    found = found.groupBy("row").agg(F.collect_list("start").alias("found_starts"), F.collect_list("size").alias("found_sizes"))
    none = lambda n, t: F.coalesce(n, F.array().cast(f"array<{t}>")).alias(n)
    joined = marked.join(found, "row", "left").select("row", "doc_id", "n_bytes", "sha256", "starts", "sizes", "codes", none("found_starts", "long"), none("found_sizes", "int"))
    return checkpointed(joined.mapInArrow(_united(length), SPANS))


def cut(data: bytes, removed: list[dict]) -> bytes:
    out, at = [], 0
    for span in removed:
        out.append(data[at : span["start"]])
        at = span["stop"]
    out.append(data[at:])
    return b"".join(out)


def cleaned(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with text cut and n_chars counted anew; characters that a cut splits lose their other bytes too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            kept = [t if t is None or not s else cut(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(texts, batch.column("__spans").to_pylist(), strict=True)]
            out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))
            yield out.select([n for n in out.schema.names if n not in ("__row", "__spans")])

    found = spans(documents, length).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    out = numbered(documents).join(found, "__row").mapInArrow(rows, documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    found = spans(documents, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    counted = found.select("row", "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "sha256", "spans")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    plain = counted.filter("n_removed = 0 OR n_removed = n_bytes").select(*columns[:4], F.when(F.col("n_removed") == 0, F.col("sha256")).otherwise(F.lit(_NOTHING)).alias("kept_sha256"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept = [hashlib.sha256(cut(t.encode(), s)).hexdigest() for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns[:4]), pa.array(kept, pa.string())], columns)

    texts = with_text(documents.withColumn("row", F.monotonically_increasing_id()), "row").select("row", "text")
    partly = counted.filter("n_removed > 0 AND n_removed < n_bytes").drop("sha256").join(texts, "row")
    return plain.unionByName(partly.mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
