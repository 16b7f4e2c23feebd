"""Reading bits and bytes: a seekable window over a file, a bit reader, and text in the encodings of media files."""

from __future__ import annotations

import io
import re
from typing import BinaryIO

#: Bytes that a window reads at least.
WINDOW = 256 * 1024


class Window:
    """A cursor over a file or bytes that holds one window of it at a time."""

    def __init__(self, source: bytes | BinaryIO):
        self.file = io.BytesIO(source) if isinstance(source, bytes | bytearray | memoryview) else source
        self.size = self.file.seek(0, io.SEEK_END)
        self.at = self.base = 0
        self.held = b""

    def window(self, at: int, n: int) -> bytes:
        """Up to n bytes from at, clipped at the end of the file."""
        n = max(0, min(n, self.size - at))
        if not (self.base <= at and at + n <= self.base + len(self.held)):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(min(max(n, WINDOW), self.size - at))
        return self.held[at - self.base : at - self.base + n]

    def seek(self, at: int) -> None:
        self.at = at

    def skip(self, n: int) -> None:
        self.at += n

    def peek(self, n: int) -> bytes:
        return self.window(self.at, n)

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def read_exact(self, n: int) -> bytes | None:
        """n bytes, or none where the file ends before."""
        return self.read(n) if self.at + n <= self.size else None

    def integer(self, n: int, order: str = "big") -> int | None:
        got = self.read_exact(n)
        return None if got is None else int.from_bytes(got, order)


class Bits:
    """Bits from the most significant one; what lies beyond the end raises EOFError."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def peek(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        return self.value >> (self.left - n) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        out = self.peek(n)
        self.left -= n
        return out

    def align(self) -> None:
        self.left -= self.left % 8

    def ue(self) -> int:
        """An Exp-Golomb number."""
        zeros = 0
        while not self.bits(1):
            zeros += 1
            if zeros > 32:
                raise EOFError
        return (1 << zeros) - 1 + self.bits(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def unescaped(data: bytes) -> bytes:
    """Without the emulation-prevention byte of each 00 00 03."""
    return re.sub(rb"\x00\x00\x03", b"\x00\x00", data)


def latin1(data: bytes) -> str:
    return cstr(data.decode("latin-1"))


def cstr(text: str) -> str:
    """Up to the first zero character."""
    return text.split("\0", 1)[0]


def utf16(data: bytes, order: str = "big") -> str:
    """UTF-16 by its byte-order mark, else in the order given; an odd last byte is dropped."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order, data = ("little" if data[:1] == b"\xff" else "big"), data[2:]
    return data[: len(data) // 2 * 2].decode("utf-16-le" if order == "little" else "utf-16-be", "replace")


def clean(text: str) -> str:
    """Without control characters but line feeds and tabs, and without outer white space."""
    return "".join(c for c in text if c in "\n\t" or not (ord(c) < 32 or 127 <= ord(c) < 160)).strip()
