"""Best-fit packing: greedy filling, then best-two-fit replacement within each sequence.

A sequence is filled with the longest pieces that still fit. Then its smallest piece is taken out if two unpacked
pieces together fill the widened gap more tightly than it did. Pieces are dealt to groups of about GROUP pieces by a
hash, so that no task's work grows with the table, while each group still packs to within a sequence of its best.

Only documents of more than CAPACITY ids are cut. Defined results: a null or empty text is the single id 0; repeated
rows are packed each (their doc_id and piece repeat); null doc_ids are packed like others; other columns are ignored;
pieces of equal length are taken in
the order of row and piece, last first; an empty table gives no sequences. A very long text is one piece of its own.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import checkpointed, gather, pieces, with_text
from reelframe.llm.textstats import Words

CAPACITY = 2048
END_ID = 0
GROUP = 20_000
#: Distinct parts of chunks whose ids a worker keeps; beyond that it starts anew.
KEPT_PARTS = 250_000
#: Text bytes that are encoded at once: in larger pieces the same chunks come again, so fewer are split.
PIECE = 2 << 20
#: Chunks of ASCII and the letters of Latin-1 are cut into the vocabulary's words here, and only new words are encoded; all
#: other chunks (and those that may hold a special token) go to the library whole. These letters are c3 and one of these bytes.
_SECOND = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
#: The normaliser and the splitter that this holds for; texts go to the library whole with any other.
_NORMALIZERS = [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+|\n")
#: What bytes are in the vocabulary; blanks stay, as words are joined by them.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: c for b, c in zip([*_OWN, *(b for b in range(256) if b not in _OWN)], [*_OWN, *range(256, 512)], strict=False) if b != 32}


def splits_at_blanks(settings: dict) -> bool:
    """Whether a vocabulary file normalises and splits texts as ChunkIds does."""
    normal = (settings.get("normalizer") or {}).get("normalizers", [])
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [(x["type"], x.get("pattern"), x.get("content")) for x in normal] == _NORMALIZERS
        and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": _SPLIT} and not split[1]["add_prefix_space"]
    )


class ChunkIds:
    """Ids of texts, split once per distinct chunk between blanks of a piece, and encoded once per distinct part of a chunk.

    The vocabulary drops white space and never merges across it, so the ids of a text are those of its chunks in turn.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for parts, whose bytes are already the vocabulary's. Zeros between parts stand alone: 0 is a part of its own.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.zero = self.words.encode("0", add_special_tokens=False).ids
        with open(path, encoding="utf-8") as file:
            self.chunked = splits_at_blanks(json.load(file)) and len(self.zero) == 1
        self.reset()

    def reset(self) -> None:
        """Part 0 is the end of a chunk, without ids; part 1 is the zero."""
        self.at = {"\n": 0, "0": 1}
        self.ids, self.starts = np.array(self.zero, np.uint32), np.array([0, 0, len(self.zero)], np.int64)

    def _library(self, many: list[str]) -> Iterator[list[int]]:
        for first in range(0, len(many), 8192):
            yield from (x.ids for x in self.tokenizer.encode_batch_fast(many[first : first + 8192], add_special_tokens=False))

    def _learn(self, new: list[str]) -> None:
        ids, size = [self.ids], []
        for first in range(0, len(new), 1 << 14):
            many = new[first : first + (1 << 14)]
            joined = [" 0 ".join(many[k : k + 64]).encode().decode("latin-1").translate(_BYTES) for k in range(0, len(many), 64)]
            found = np.fromiter(chain.from_iterable(chain(x.ids, self.zero) for x in self.words.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
            end = np.flatnonzero(found == self.zero[0])
            size.append(np.diff(np.append(-1, end)) - 1)
            ids.append(np.delete(found, end))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(size)))
        self.ids = np.concatenate(ids)

    def _plain(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, one chunk after the other, and how many each has."""
        size = ends - starts + 1
        data = flat[np.minimum(gather(starts, size), len(flat) - 1)]
        data[np.cumsum(size) - 1] = 10
        parts = _PARTS.findall(data.tobytes().decode().lower())
        if new := sorted(set(parts) - self.at.keys()):
            self._learn(new)
        part = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
        first = self.starts[part]
        size = self.starts[part + 1] - first
        return self.ids[gather(first, size)], np.diff(np.append(0, np.cumsum(size)[part == 0]))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.chunked:
            return [np.array(x, np.uint32) for x in self._library([x or "" for x in column.to_pylist()])]
        if len(self.at) > KEPT_PARTS:
            self.reset()
        words = Words(column)
        _, at, inverse = np.unique(words.hashes(False), return_index=True, return_inverse=True)
        starts, ends = words.starts[at], words.ends[at]
        plain = ~_within(_odd(words.flat), starts, ends)
        whole = np.flatnonzero(~plain)
        others = [np.array(x, np.uint32) for x in self._library([words.flat[i:j].tobytes().decode() for i, j in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)])]
        ids, size = self._plain(words.flat, starts[plain], ends[plain])
        number = np.empty(len(at), np.int64)
        number[plain], number[whole] = size, list(map(len, others))
        first = np.empty(len(at), np.int64)
        first[plain], first[whole] = np.cumsum(size) - size, len(ids) + np.cumsum(number[whole]) - number[whole]
        pool, size = np.concatenate([ids, *others]), number[inverse]
        out = pool[gather(first[inverse], size)]
        bounds = np.append(0, np.cumsum(size))[np.append(words.first, len(words.starts))]
        return [out[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _odd(flat: np.ndarray) -> np.ndarray:
    """Bytes that no plain chunk has: of other letters, and those that begin a special token."""
    before, after = np.append(np.uint8(0), flat[:-1]), np.append(flat[1:], np.uint8(0))
    return np.where(flat < 0x80, (flat == ord("<")) & (after == ord("|")), ~((flat == 0xC3) & _SECOND[after] | (before == 0xC3) & _SECOND[flat]))


def _within(marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span has a marked byte."""
    places = np.flatnonzero(marked)
    return np.searchsorted(places, starts) < np.searchsorted(places, ends)


_encoders: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    if path not in _encoders:
        _encoders[path] = ChunkIds(path)
    return _encoders[path]


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of at most capacity ids, in shared storage. tokenizer: path of the vocabulary file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in pieces(batches, limit=PIECE):
            found: list[tuple] = []
            for row, doc, ids in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), own.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    found.append((row, doc, k, start, len(part), crc32(part.tobytes())))
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return checkpointed(with_text(documents.withColumn("row", F.monotonically_increasing_id()), "row").mapInArrow(rows, PIECES))


def best_two_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of places in sizes, each of at most capacity in all."""
    stacks: dict[int, list[int]] = {}
    for place, size in enumerate(sizes):
        stacks.setdefault(size, []).append(place)
    order = sorted(stacks)

    def take(size: int) -> int:
        stack = stacks[size]
        place = stack.pop()
        if not stack:
            del stacks[size]
            order.pop(bisect_right(order, size) - 1)
        return place

    bins = []
    while order:
        room, own = capacity, []
        while order and (k := bisect_right(order, room)):
            size = order[k - 1]
            own.append((size, take(size)))
            room -= size
        if room and len(own) > 1 and order:
            small, place = own[-1]
            gap = small + room  # wider than before by what the smallest piece held
            best, pair = small, None
            i, j = 0, bisect_right(order, gap) - 1
            while i <= j:
                both = order[i] + order[j]
                if both > gap or (i == j and len(stacks[order[i]]) < 2):
                    j -= 1
                    continue
                if both > best:
                    best, pair = both, (order[i], order[j])
                    if best == gap:
                        break
                i += 1
            if pair:
                own[-1:] = [(size, take(size)) for size in pair]
                if small not in stacks:
                    order.insert(bisect_right(order, small), small)
                stacks.setdefault(small, []).append(place)
        bins.append([place for _, place in own])
    return bins


OUT = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with the sequence and the offset that each got."""
    groups = max(1, math.ceil(cut_pieces.count() / group))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        mine = pa.Table.from_batches(held).sort_by([("row", "ascending"), ("piece", "ascending")])
        sizes = mine.column("length").to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = TaskContext.get().partitionId() << 32
        for k, own in enumerate(best_two_fit(sizes, capacity)):
            at = 0
            for place in own:
                sequence[place], offset[place] = base + k, at
                at += sizes[place]
        yield from mine.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    return cut_pieces.repartition(groups, F.xxhash64("row", "piece")).mapInArrow(rows, OUT)


def packed(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(cut(documents, tokenizer, capacity), capacity, group).drop("row")
