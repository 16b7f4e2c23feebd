"""LM scoring: context-tree weighting over bytes, with a word-frequency base beside it.

A byte is eight binary decisions, one per node of the byte's binary tree; each node has a context tree over the DEPTH
bytes before it, whole bytes at every depth (zeros stand before a text). Every node keeps Krichevsky-Trofimov counts;
bottom-up, each context weighs its own estimate against its longer contexts (half each before the data), and these
weights mix the estimates of all depths into one probability per decision. A text's score is log10 of the product over
its bytes and a closing zero byte; the code length per byte follows from it.

The counts stay distributed and grow with the corpus: a chunk of texts sends its distinct pairs of context and byte,
packed, to the task of their group, which sums them over all chunks, builds that part of the tree and answers each pair
by its log10 probability. A group is all that ends in one context; a context that more than 1 / SHARES of all bytes
follow (and more than LEAST) is divided, its longer contexts make groups of their own. So no group has much more than
1 / SHARES of the corpus, however frequent a letter or a passage is. The divided contexts, at most SHARES per depth, are
collected and broadcast with their exact counts and weights: the packed counts are kept where they have met, each
group tells the counts and the mixtures of its shortest context, and from their sums the driver goes on to the
divided contexts, the longest first. So the same scores come out whether and wherever contexts are divided. An answer
is a half-precision number, which moves a score by some 1e-4 of itself at most.

The base score comes from counts of words over all training texts, summed in the same exchange by hash, so the
vocabulary is never held in one place.

Defined results: a null or empty text scores its closing byte, and its base is the end token alone; without training rows
every count is zero; repeated rows are scored each; null doc_ids hash as empty text; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, flat_bytes, fold, gather, pieces, spread, with_text
from reelframe.llm.exchange import ROW, Answer, batch_of, bucket_of, buckets_for, chunk_name, grouped, homed, meeting, told, unpack
from reelframe.llm.textstats import Words, mix

#: Bytes of the longest context.
DEPTH = 6
#: A context is divided when more than this share of all bytes, and more than LEAST of them, follow it.
SHARES, LEAST = 4096, 1 << 16
#: Text bytes of a chunk of the exchange, and of what is counted or looked up at once.
CHUNK_BYTES, PART_BYTES = 12 << 20, 4 << 20
#: Buckets of contexts for each bucket of words.
CONTEXT_BUCKETS = 4
_HALF = math.lgamma(0.5)


def keys_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol at every byte of each text and at its closing zero, and the texts' bounds.

    The byte just before the symbol is the highest of a key, so contexts with one ending are neighbours in rising order.
    """
    bounds = offsets + np.arange(len(offsets))
    padded, keys = np.zeros(bounds[-1] + DEPTH * len(offsets) + 8, np.uint8), np.empty(bounds[-1], "<u8")
    windows = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    for k, (i, j, to) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[:-1].tolist(), strict=True)):
        at = to + DEPTH * k  # zeros stand before a text's first byte and at its end
        padded[at + DEPTH : at + DEPTH + j - i] = flat[i:j]
    for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        keys[i:j] = windows[i + DEPTH * k : j + DEPTH * k]
    symbols = keys >> np.uint64(8 * DEPTH) & np.uint64(255)
    keys <<= np.uint64(64 - 8 * DEPTH)
    keys >>= np.uint64(56 - 8 * DEPTH)
    keys |= symbols
    return keys, bounds


def context(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys >> np.uint64(8 * (DEPTH + 1 - depth))


def counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys, and how often each stands in a training text."""
    packed = keys << np.uint64(1)
    packed |= learned.astype(np.uint64)
    packed.sort()
    first = _starts(packed >> np.uint64(1))
    return packed[first] >> np.uint64(1), np.add.reduceat(packed & np.uint64(1), first).astype(np.int64) if len(first) else np.empty(0, np.int64)


def _starts(rising: np.ndarray) -> np.ndarray:
    new = np.ones(len(rising), bool)
    new[1:] = rising[1:] != rising[:-1]
    return np.flatnonzero(new)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift; exact to about 1e-12 for x >= 0.5."""
    y, shift = x.astype(float), np.zeros(x.shape)
    for _ in range(7):
        shift += np.log(y)
        y = y + 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


_SMALL = 1 << 12
#: Exact, so that the block of no symbols is 0 and contexts that only held-out texts have add nothing.
_AT_HALVES, _AT_WHOLES = (np.array([math.lgamma(k + x) for k in range(_SMALL)]) for x in (0.5, 1.0))


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a block with these counts."""
    both = (zeros + ones).astype(np.int64)
    small = both < _SMALL
    at = np.where(small, both, 0)
    out = _AT_HALVES[np.where(small, zeros, 0).astype(np.int64)] + _AT_HALVES[np.where(small, ones, 0).astype(np.int64)] - _AT_WHOLES[at] - 2 * _HALF
    large = np.flatnonzero(~small)
    if len(large):
        out[large] = _log_gamma(zeros[large] + 0.5) + _log_gamma(ones[large] + 0.5) - _log_gamma(both[large] + 1.0) - 2 * _HALF
    return out


def _nodes(pairs: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes that decide this bit of rising pairs of context and symbol.

    Returns each node's first pair, the node of each pair, the nodes' zeros and ones, and the estimate of each pair's own bit.
    """
    prefix = pairs >> np.uint64(8 - bit)
    first = _starts(prefix)
    node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pairs))))
    value = (pairs >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
    total, ones = np.add.reduceat(counts, first), np.add.reduceat(np.where(value, counts, 0), first)
    zeros = total - ones
    return first, node, zeros, ones, (np.where(value, ones[node], zeros[node]) + 0.5) / (total[node] + 1)


def _shorter(pairs: np.ndarray) -> np.ndarray:
    """Pairs without the oldest byte of their contexts."""
    return pairs >> np.uint64(16) << np.uint64(8) | pairs & np.uint64(255)


class Divided:
    """The contexts that are divided, with the weight and the chance of a one at each of their nodes."""

    def __init__(self, depth: np.ndarray, values: np.ndarray):
        self.contexts = [np.sort(values[depth == d]).astype(np.uint64) for d in range(DEPTH)]
        self.weights = [np.full((len(c), 256), 0.5) for c in self.contexts]
        self.chances = [np.full((len(c), 256), 0.5) for c in self.contexts]

    def any(self) -> bool:
        return any(map(len, self.contexts))

    def places(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the context of each key stands among the divided ones of a depth, and whether it does."""
        own, wanted = self.contexts[depth], context(keys, depth)
        if not len(own):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return at, own[at] == wanted

    def ranges(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the rising keys that have each divided context of a depth."""
        own, shift = self.contexts[depth], np.uint64(8 * (DEPTH + 1 - depth))
        return np.searchsorted(keys, own << shift), np.searchsorted(keys, own + np.uint64(1) << shift)

    def home(self, keys: np.ndarray) -> np.ndarray:
        """The depth of the first context of each rising key that isn't divided.

        A divided context's endings are divided too: they are at least as frequent in every part and in all.
        """
        step = np.zeros(len(keys) + 1, np.int64)
        for d in range(DEPTH):
            first, end = self.ranges(keys, d)
            np.add.at(step, first, 1)
            np.add.at(step, end, -1)
        return np.cumsum(step)[:-1]

    def buckets(self, keys: np.ndarray, number: int) -> np.ndarray:
        """The bucket of the group of each rising key."""
        home = self.home(keys).astype(np.uint64)
        ending = (keys >> np.uint64(8) * (np.uint64(DEPTH + 1) - home)) * np.uint64(8) + home
        first = _starts(ending)
        own = ((mix(ending[first] + np.uint64(1)) >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64)
        return np.repeat(own, np.diff(np.append(first, len(keys))))

    def learn(self, at: np.ndarray, amount: np.ndarray) -> None:
        """What the undivided children of each divided context told, in sum (places as _told() gives them)."""
        depth, place, ending = at & 7, at >> 3 & 511, (at >> 12).astype(np.uint64)
        sums = [np.zeros((len(own), 512)) for own in self.contexts]
        for d, own in enumerate(self.contexts):
            rows = np.flatnonzero(depth == d)
            sums[d][np.searchsorted(own, ending[rows]), place[rows]] = amount[rows]
        for d in range(DEPTH - 1, -1, -1):
            own, table = self.contexts[d], sums[d]
            heap = np.concatenate([np.zeros((len(own), 256)), table[:, :256]], axis=1)
            for j in range(255, 0, -1):
                heap[:, j] = heap[:, 2 * j] + heap[:, 2 * j + 1]
            zeros, ones = heap[:, 0::2], heap[:, 1::2]
            block = _block(zeros.ravel(), ones.ravel()).reshape(zeros.shape)
            both = np.logaddexp(block, table[:, 256:])
            self.weights[d] = np.exp(block - both)
            self.chances[d] = (ones + 0.5) / (zeros + ones + 1)
            if d:
                np.add.at(sums[d - 1], np.searchsorted(self.contexts[d - 1], own >> np.uint64(8)), np.concatenate([table[:, :256], both - np.log(2)], axis=1))

    def log_chances(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probability of each key's symbol after its context; keys: whole groups, rising, with their training counts."""
        out, home = np.zeros(len(keys)), self.home(keys)
        for top in np.unique(home):
            rows = np.flatnonzero(home == top)
            own = keys[rows]
            above = [(d, self.places(own, d)[0]) for d in range(top - 1, -1, -1)]
            total = np.zeros(len(rows))
            for bit, chance in enumerate(_mixed(own, counts[rows], int(top))):
                node = (1 << bit) | (own & np.uint64(255)).astype(np.int64) >> 8 - bit
                one = (own >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
                for d, at in above:
                    weight, ones = self.weights[d][at, node], self.chances[d][at, node]
                    chance = weight * np.where(one, ones, 1 - ones) + (1 - weight) * chance
                total += np.log10(chance)
            out[rows] = total
        return out


def _levels(keys: np.ndarray, counts: np.ndarray, top: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Pairs and counts at the depths from DEPTH up to top, and the place of each pair in the level after its own."""
    levels, up = [(keys, counts)], []
    for _ in range(DEPTH - top):
        pairs, own = levels[-1]
        shorter, place = np.unique(_shorter(pairs), return_inverse=True)
        up.append(place)
        levels.append((shorter, np.bincount(place, weights=own, minlength=len(shorter)).astype(np.int64)))
    return levels, up


def _told(keys: np.ndarray, counts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """What groups of depth top tell the divided contexts that they are children of: places and amounts.

    A place is ending * 4096 + number * 8 + depth of such a context. number under 256: how often that symbol follows;
    256 and over: log of the mixture of a child at a node.
    """
    levels, up = _levels(keys, counts, top)
    pairs, own = levels[-1]
    places, amounts = [pairs >> np.uint64(16) << np.uint64(9) | pairs & np.uint64(255)], [own.astype(float)]
    for bit in range(8):
        first, _, zeros, ones, _ = _nodes(*levels[0], bit)
        below = _block(zeros, ones)
        for (pairs, own), to in zip(levels[1:], up, strict=True):
            children = to[first]
            first, node, zeros, ones, _ = _nodes(pairs, own, bit)
            below = np.logaddexp(_block(zeros, ones), np.bincount(node[children], weights=below, minlength=len(first))) - np.log(2)
        node = (np.uint64(1 << bit) | (pairs[first] & np.uint64(255)) >> np.uint64(8 - bit)) + np.uint64(256)
        places.append(pairs[first] >> np.uint64(16) << np.uint64(9) | node)
        amounts.append(below)
    place, inverse = np.unique(np.concatenate(places), return_inverse=True)
    return (place << np.uint64(3) | np.uint64(top - 1)).astype(np.int64), np.bincount(inverse, weights=np.concatenate(amounts), minlength=len(place))


def _mixed(keys: np.ndarray, counts: np.ndarray, top: int) -> Iterator[np.ndarray]:
    """For each bit, the probability of the keys' own bit from the weighted contexts of depth top to DEPTH."""
    levels, up = _levels(keys, counts, top)
    for bit in range(8):
        first, _, zeros, ones, chance = _nodes(*levels[0], bit)
        below, place = _block(zeros, ones), np.arange(len(keys))
        for (pairs, own), to in zip(levels[1:], up, strict=True):
            children = to[first]
            first, node, zeros, ones, estimate = _nodes(pairs, own, bit)
            block = _block(zeros, ones)
            both = np.logaddexp(block, np.bincount(node[children], weights=below, minlength=len(first)))
            weight, place = np.exp(block - both)[node], to[place]
            chance = weight[place] * estimate[place] + (1 - weight[place]) * chance
            below = both - np.log(2)
        yield chance


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts of a batch, and whether each stands in a training text."""
    keys, bounds = keys_of(*flat_bytes(batch.column("text")))
    return keys, np.repeat(batch.column("learned").to_numpy(zero_copy_only=False), np.diff(bounds))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that are frequent enough in a part of the texts to be divided, perhaps, with their numbers there."""
    for batch in pieces(batches, limit=PART_BYTES):
        keys, _ = _keys(batch)
        keys.sort()
        for d in range(DEPTH):
            first = _starts(context(keys, d)) if d else np.zeros(1, np.int64)
            size = np.diff(np.append(first, len(keys)))
            kept = size * 4 * SHARES > len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), d)), pa.array((context(keys[first[kept]], d)).astype(np.int64)), pa.array(size[kept].astype(np.int64))], ["depth", "ending", "n"])


def frequent(rows: DataFrame) -> Divided:
    """rows: text and learned. The contexts that are divided, at most SHARES * DEPTH, with no weights yet."""
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0))).first()[0]
    least = max(LEAST, total // SHARES)
    empty = np.empty(0, np.int64)
    if total <= least:
        return Divided(empty, empty)
    hot = rows.mapInArrow(_frequent, "depth long, ending long, n long").groupBy("depth", "ending").agg(F.sum("n").alias("n")).filter(F.col("n") > least).toArrow()
    return Divided(hot.column("depth").to_numpy(), hot.column("ending").to_numpy())


def _summed(own: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising distinct keys of all chunks, the place of each chunk's keys among them, and the sums of their counts."""
    distinct, inverse = np.unique(np.concatenate(own), return_inverse=True)
    return distinct, inverse, np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)


def _tell(divided, buckets: int):
    """From rows that have met: what the groups tell the divided contexts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in grouped(batches, "bucket"):
            if bucket < buckets:
                continue
            counts = [_grown(r["b"], np.uint32) for r in own]
            keys, _, total = _summed([_grown(r["a"], np.uint64)[n > 0] for r, n in zip(own, counts, strict=True)], np.concatenate([n[n > 0] for n in counts]))
            home = divided.value.home(keys)
            for top in np.unique(home[home > 0]).tolist():
                at, amount = _told(keys[home == top], total[home == top], top)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(amount)], ["at", "amount"])

    return rows


def meet(rows: DataFrame) -> tuple[Divided, DataFrame, int]:
    """rows: doc_id, text and learned. The divided contexts with their weights, the packed rows that have met, and the buckets of words."""
    context, parts, buckets = rows.sparkSession.sparkContext, spread(rows), buckets_for(rows)
    divided = frequent(rows)
    met = meeting(homed(rows.mapInArrow(_pack(context.broadcast(divided), buckets), ROW)), parts)
    if divided.any():
        met = checkpointed(met)
        known = met.mapInArrow(_tell(context.broadcast(divided), buckets), "at long, amount double").groupBy("at").agg(F.sum("amount").alias("amount")).toArrow()
        divided.learn(known.column("at").to_numpy(), known.column("amount").to_numpy())
    return divided, met, buckets


def fit(rows: DataFrame) -> Divided:
    """rows: doc_id, text and learned. The divided contexts and their weights."""
    return meet(rows)[0]


def _shrunk(values: np.ndarray) -> bytes:
    """Planes of the values' bytes, compressed: of rising keys and small counts the high ones repeat."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _grown(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and words of each text."""
    parts = [Words(piece.column("text")) for piece in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]))]
    return np.concatenate([w.hashes(True) for w in parts] or [np.empty(0, np.uint64)]), np.concatenate([w.per_doc for w in parts] or [np.empty(0, np.int64)])


def _pack(divided, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(pieces(batches, limit=CHUNK_BYTES)):
            chunk, learned = chunk_name(number), batch.column("learned").to_numpy(zero_copy_only=False)
            flat, offsets = flat_bytes(batch.column("text"))
            hashes, per_doc = _words(batch.column("text"))
            distinct, place = np.unique(hashes, return_inverse=True)
            count = np.bincount(place, weights=np.repeat(learned, per_doc), minlength=len(distinct)).astype(np.int64)
            known = batch.column("doc_id")
            table = np.stack([known.fill_null(0).to_numpy(), known.is_null().to_numpy(zero_copy_only=False).astype(np.int64), learned.astype(np.int64), np.diff(offsets)], axis=1)
            yield batch_of([(chunk, -1, table.astype(np.int64).tobytes(), _shrunk(flat), b"")])
            out, bucket = [], bucket_of(distinct, buckets)
            first = _starts(bucket)
            for i, j in zip(first, np.append(first[1:], len(bucket)), strict=True):
                out.append((chunk, int(bucket[i]), _shrunk(distinct[i:j]), _shrunk(count[i:j].astype(np.uint32)), b""))
            del hashes, place, distinct, count
            keys, n = counted(*_keys(batch))
            bucket = divided.value.buckets(keys, CONTEXT_BUCKETS * buckets)
            order = np.argsort(bucket, kind="stable")
            first = _starts(bucket[order])
            for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
                own = order[i:j]
                out.append((chunk, buckets + int(bucket[own[0]]), _shrunk(keys[own]), _shrunk(n[own].astype(np.uint32)), b""))
            for i in range(0, len(out), 64):
                yield batch_of(out[i : i + 64])

    return rows


#: The name under which each bucket tells how many of its words were seen in training.
_STATISTICS = "~"


def _answer(divided, buckets: int):
    """To each chunk, in its own order, what all chunks tell of its words (counts) or of its contexts (log10 chances)."""

    def answers(rows: list[dict]) -> Iterator[Answer]:
        words = rows[0]["bucket"] < buckets
        own = [_grown(r["a"], np.uint64) for r in rows]
        ends = np.cumsum([len(k) for k in own])
        distinct, inverse, total = _summed(own, np.concatenate([_grown(r["b"], np.uint32) for r in rows]))
        if words:
            yield _STATISTICS, rows[0]["bucket"], int((total > 0).sum()).to_bytes(8, "little"), b"", b""
        values = total if words else divided.value.log_chances(distinct, total).astype(np.float16)
        for r, k, j in zip(rows, own, ends, strict=True):
            yield r["chunk"], r["bucket"], values[inverse[j - len(k) : j]].tobytes(), b"", b""

    return answers


COUNTED = "vocabulary long, doc_id long, held_out boolean, words long, known long, logs double, score double"


def _assemble(divided, buckets: int):
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def documents(chunk: str, payload: dict | None, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        if payload is None:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([sum(int.from_bytes(r["a"], "little") for r in answers)]), *none], names)
            return
        table = unpack(payload["a"], np.int64).reshape(-1, 4)
        offsets = np.append(0, np.cumsum(table[:, 3]))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(table), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_grown(payload["b"], np.uint8).tobytes())])
        hashes, per_doc = _words(column)
        place = np.unique(hashes, return_inverse=True)[1]
        count = np.concatenate([unpack(r["a"], np.int64) for r in answers if r["bucket"] < buckets] or [np.empty(0, np.int64)])[place]
        doc = np.repeat(np.arange(len(table)), per_doc)
        logs = np.bincount(doc, weights=np.log10(count + 0.5), minlength=len(table))
        known = np.bincount(doc, weights=count > 0, minlength=len(table)).astype(np.int64)
        del hashes, place, count, doc
        found, scores = [], []
        for piece in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])])):
            own, bounds = keys_of(*flat_bytes(piece.column("text")))
            order = np.argsort(own)
            own = own[order]
            first = _starts(own)
            at = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))[order]
            found.append((own[first], np.diff(np.append(first, len(own))).astype(np.int32), at, len(bounds) - 1))
        keys = np.concatenate([f[0] for f in found])
        keys.sort()
        keys = keys[_starts(keys)]
        chances = np.empty(len(keys), np.float32)
        chances[np.argsort(divided.value.buckets(keys, CONTEXT_BUCKETS * buckets), kind="stable")] = np.concatenate([unpack(r["a"], np.float16) for r in answers if r["bucket"] >= buckets])
        for own, size, at, n in found:
            scores.append(np.bincount(at, weights=np.repeat(chances[np.searchsorted(keys, own)], size), minlength=n))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(table), pa.int64()), pa.array(table[:, 0], mask=table[:, 1] > 0), pa.array(table[:, 2] == 0), pa.array(per_doc), pa.array(known), pa.array(logs), pa.array(np.concatenate(scores))],
            names,
        )

    return documents


def scored(documents: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = with_text(documents).withColumn("learned", fold(F.col("doc_id")) != held_out_fold)
    found, met, buckets = meet(rows)
    divided = documents.sparkSession.sparkContext.broadcast(found)
    counts = checkpointed(told(met, _answer(divided, buckets), _assemble(divided, buckets), COUNTED, spread(documents)))
    trained = F.col("held_out") == F.lit(False)
    totals = counts.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)), F.coalesce(F.sum(F.when(trained, F.col("words"))), F.lit(0)), F.count_if(trained)).first()
    ends = int(totals[2])
    tokens, vocabulary = int(totals[1]) + ends, int(totals[0]) + int(ends > 0)
    scale = float(np.log10(tokens + 0.5 * (vocabulary + 1)))
    base = F.col("logs") + F.lit(float(np.log10(ends + 0.5))) - (F.col("words") + 1) * F.lit(scale)
    return counts.filter("held_out IS NOT NULL").select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def code_length(score: float, n_bytes: int) -> float:
    """Bits per byte, the closing byte included."""
    return -score / np.log10(2) / (n_bytes + 1)
