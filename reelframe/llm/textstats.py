"""Words, lines and polynomial hashes of whole texts, computed on the UTF-8 bytes of a batch with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from reelframe.llm.common import flat_bytes

_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SECOND_ODD = 0xD1342543DE82EF95
_SECOND_TABLE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}
#: Powers that a worker keeps between tasks.
KEPT_POWERS = 1 << 21


def forget() -> None:
    """Drop tables of powers that a very long text has made."""
    for name in [k for k, v in _powers.items() if len(v) > KEPT_POWERS]:
        del _powers[name]


def _ladder(name: str, base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n at least, kept for the next batch."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0], filled = 1, 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a uint64 array spread over all places."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(flat: np.ndarray, lower: bool = False) -> np.ndarray:
    """n + 1 prefix sums of table[byte] * base**place modulo 2**64."""
    return _prefix(flat, _LOWER_TABLE if lower else _TABLE, "up", _ODD)


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever it stands."""
    return _spans(prefix, starts, ends, "down", _ODD)


def second_prefix_hashes(flat: np.ndarray) -> np.ndarray:
    """prefix_hashes() with byte values and a base of its own."""
    return _prefix(flat, _SECOND_TABLE, "up2", _SECOND_ODD)


def second_span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span that doesn't depend on span_hashes(); prefix: second_prefix_hashes()."""
    return _spans(prefix, starts, ends, "down2", _SECOND_ODD)


def _prefix(flat: np.ndarray, values: np.ndarray, ladder: str, base: int) -> np.ndarray:
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(values[flat] * _ladder(ladder, base, len(flat))[: len(flat)], out=out[1:])
    return out


def _spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, ladder: str, base: int) -> np.ndarray:
    down = _ladder(ladder, pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts.

    starts, ends: byte places in flat; doc: row of each word; per_doc: words of each row; first: its first word.
    """

    def __init__(self, column: pa.Array):
        self.flat, self.offsets = flat_bytes(column)
        self.n = len(self.offsets) - 1
        inside = ~_SPACE[self.flat]
        self.inside = inside
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        cuts = self.offsets[:-1]
        before[cuts[cuts < len(inside)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        lasts = self.offsets[1:]
        after[lasts[lasts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets[:-1]).astype(np.int64)
        bounds = np.append(self.first, len(self.starts))
        self.per_doc = np.diff(bounds)
        self.doc = np.repeat(np.arange(self.n), self.per_doc)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(prefix_hashes(self.flat, lower), self.starts, self.ends)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per row of a value per byte."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of size words that stays within a row."""
    counts = np.maximum(words.per_doc - size + 1, 0)
    from reelframe.llm.common import gather

    at = gather(words.first, counts)
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(_ODD) + hashes[at + k])
    return at, value


def salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that agree only within one row of the batch."""
    return mix(hashes ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) & np.uint64(_MASK)))
