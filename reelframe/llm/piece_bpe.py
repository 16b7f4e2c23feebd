"""SentencePiece encoding and decoding: byte-fallback BPE merged in vectorised rounds.

Texts become symbols (one per character, blanks as U+2581, one blank put in front). Words start at each run of blanks;
since no piece of the vocabulary has a blank after another character, merges stay within words, so each distinct word
is encoded once per batch. All words lie in one flat numpy array; a round finds each word's best pair by a segmented
minimum over pair ranks, merges it wherever it stands from the left, and compacts the arrays, until no pair is left.

A pair that makes a symbol whose own next merge ranks before the pair itself is merged only at its leftmost place in a
round, because the sequential order would turn to that next merge first; so results equal the sequential algorithm's.
Words of over LONG_WORD symbols are merged with a heap instead, which does the same in n log n steps.

Defined results: a null or empty text is the begin and end ids alone; repeated rows are encoded each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelframe.llm.common import gather, pieces, texts, with_text

BLANK = "▁"
LONG_WORD = 400
#: Distinct words of a worker whose ids it keeps; beyond that it starts anew.
KEPT_WORDS = 300_000
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_NONE = np.int64(1) << 40


class PieceModel:
    """The vocabulary's pair table, its byte pieces, and the two directions."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = np.full(n, -1, np.int16)
        normal = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes_of[i] = int(name[1:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i)):
                normal[name] = i
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.bytes_of >= 0):
            self.byte_ids[self.bytes_of[i]] = i
        if any(BLANK in name.lstrip(BLANK) for name in normal):
            raise ValueError("a piece has a blank after another character; words of this vocabulary aren't independent")
        self.normal = normal
        self.score = {i: model.get_score(i) for i in normal.values()}
        # Rank of a merged piece: place by falling score; equal scores share a rank, and then the leftmost pair is first.
        places = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        rank = {i: places[s] for i, s in self.score.items()}
        pairs = [(normal[name[:k]], normal[name[k:]], i) for name, i in normal.items() for k in range(1, len(name)) if name[:k] in normal and name[k:] in normal]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.rank_of = np.full(n, _NONE)
        for i, r in rank.items():
            self.rank_of[i] = r
        self.hurried = np.zeros(n, bool)
        for a, b, i in pairs:
            for part in (a, b):
                if rank[i] <= rank[part]:
                    self.hurried[part] = True
        self.pair_made = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        self.surface = [BLANK if model.is_control(i) else name for i, name in enumerate(names)]
        self.silent = np.array([model.is_control(i) for i in range(n)])
        self.encoded = [b"" if model.is_control(i) else bytes([self.bytes_of[i]]) if self.bytes_of[i] >= 0 else " ⁇ ".encode() if i == self.unknown else name.replace(BLANK, " ").encode() for i, name in enumerate(names)]
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int64)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbours; symbols outside the vocabulary are negative and never merge."""
        wanted = left << 20 | right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = (self.keys[place] == wanted) & (left >= 0) & (right >= 0)
        made = np.where(hit, self.made[place], 0)
        return np.where(hit, self.rank_of[made], _NONE), made

    def merge_rounds(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of n words (word: the word of each, rising) until no pair is left."""
        done_symbols, done_words = [], []
        while len(symbols):
            rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
            rank[:-1], made[:-1] = self.pairs(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.append(heads, len(word)))
            best = np.minimum.reduceat(rank, heads)
            live = np.repeat(best < _NONE, size)
            if not live.all():  # finished words leave the arrays
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, rank, made = symbols[live], word[live], rank[live], made[live]
                keep = best < _NONE
                best, size = best[keep], size[keep]
                heads = np.cumsum(size) - size
            if not len(symbols):
                break
            chosen = rank == np.repeat(best, size)
            at = np.flatnonzero(chosen)
            # Equal ranks of different pieces, and hurried pieces, go one at a time from the left.
            owner = word[at]
            first = np.r_[True, owner[1:] != owner[:-1]]
            run = np.cumsum(first) - 1
            lead = at[first][run]
            single = self.hurried[made[at]] | (made[at] != made[lead])
            careful = np.zeros(run[-1] + 1, bool)
            careful[run[single]] = True
            at = at[first | ~careful[run]]
            # Of neighbouring places of one pair (a a a), every other one from the left is merged.
            broken = np.r_[True, at[1:] != at[:-1] + 1]
            group = np.cumsum(broken) - 1
            at = at[(np.arange(len(at)) - np.flatnonzero(broken)[group]) % 2 == 0]
            symbols[at] = made[at]
            gone = np.ones(len(symbols), bool)
            gone[at + 1] = False
            symbols, word = symbols[gone], word[gone]
        if done_symbols:
            symbols, word = np.concatenate([symbols, *done_symbols]), np.concatenate([word, *done_words])
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        return symbols, word

    def merge_heap(self, symbols: list[int]) -> list[int]:
        """The same for one long word: a heap of pairs by rank, then place."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (made := self.pair_made.get(symbols[i] << 20 | symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank_of[made]), i, symbols[i], symbols[j], made))

        for i in range(n - 1):
            push(i)
        alive = [True] * n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s, here in zip(symbols, alive, strict=True) if here]

    def _learn(self, words: list[str]) -> None:
        """Encode new words and keep their ids."""
        flat = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, at = np.unique(codes, return_inverse=True)
        symbol_of = np.array([self.normal.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
        symbols, word = symbol_of[at], np.repeat(np.arange(len(words)), sizes)
        long = np.repeat(sizes > LONG_WORD, sizes)
        merged, owner = self.merge_rounds(symbols[~long], word[~long], len(words))
        if long.any():
            extra = [(w, self.merge_heap(symbols[word == w].tolist())) for w in np.flatnonzero(sizes > LONG_WORD)]
            merged = np.concatenate([merged, *(np.array(x, np.int64) for _, x in extra)])
            owner = np.concatenate([owner, *(np.full(len(x), w) for w, x in extra)])
            order = np.argsort(owner, kind="stable")
            merged, owner = merged[order], owner[order]
        odd = np.flatnonzero(merged < 0)
        if len(odd):  # characters outside the vocabulary become their UTF-8 bytes
            raw = [chr(-1 - int(merged[i])).encode("utf-8", "replace") for i in odd]
            width = np.ones(len(merged), np.int64)
            width[odd] = [len(x) for x in raw]
            ends = np.cumsum(width)
            wide, owner = np.repeat(merged, width), np.repeat(owner, width)
            wide[gather(ends[odd] - width[odd], width[odd])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            merged = wide
        per_word = np.bincount(owner, minlength=len(words))
        known, need = len(self.known), self.used + len(merged)
        while need > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while known + len(words) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        self.ids[self.used : need] = merged
        self.starts[known + 1 : known + 1 + len(words)] = self.used + np.cumsum(per_word)
        self.known.update(zip(words, range(known, known + len(words)), strict=True))
        self.used = need

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """The ids of each text, begin and end included."""
        if len(self.known) > KEPT_WORDS:
            self.reset()
        split = [_WORD.findall(BLANK + x.replace(" ", BLANK)) if x else [] for x in many]
        new = sorted({w for words in split for w in words if w not in self.known})
        if new:
            self._learn(new)
        get, out = self.known.__getitem__, []
        for words in split:
            place = np.fromiter(map(get, words), np.int64, len(words))
            starts = self.starts[place]
            body = self.ids[gather(starts, self.starts[place + 1] - starts)]
            out.append(np.concatenate([[self.begin], body, [self.end]]).astype(np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, blanks restored, the added blank dropped; runs of byte pieces are UTF-8."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        head = self.encoded[ids[0]]
        if self.bytes_of[ids[0]] < 0 and head.startswith(b" ") and ids[0] != self.unknown:
            head = head[1:]
        data = head + b"".join(map(self.encoded.__getitem__, ids[1:].tolist()))
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, head)

    def _decode_broken(self, ids: np.ndarray, head: bytes) -> str:
        """Byte pieces that aren't valid UTF-8: each byte that starts no character is U+FFFD."""
        out, i = [], 0
        while i < len(ids):
            j = i
            while j < len(ids) and self.bytes_of[ids[j]] >= 0:
                j += 1
            run = bytes(self.bytes_of[ids[i:j]].astype(np.uint8))
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[:width].decode())
                        run = run[width:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if j < len(ids):
                out.append((head if j == 0 else self.encoded[ids[j]]).decode())
            i = j + 1
        return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of long) and the text decoded from them again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in pieces(batches):
            ids = own.encode(texts(batch))
            bounds = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=bounds[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array([own.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    return with_text(documents).mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("ids").offsets.to_numpy()
            flat = batch.column("ids").values.to_numpy().astype("<u4")
            ids = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256((x or "").encode()).hexdigest() for x in batch.column("decoded").to_pylist()])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded(documents, path).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
