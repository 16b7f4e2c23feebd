"""Media columns: MPEG transport streams that carry a text's bytes as one elementary stream.

A writer multiplexes a payload into 188-byte packets: program association and program map tables (with CRC), and
elementary packets of UNIT payload bytes, each with a timestamp; every RANDOM_ACCESS-th begins with a random-access
point and a clock reference. A reader checks packet sync and continuity counters, parses the program tables,
reassembles the elementary packets of each program, and returns their timestamps and random-access points.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal streams; repeated rows are
stored each; other columns are ignored; an empty table gives an empty result. The reader skips what is cut off or out
of sync, counts it as errors, and never raises on damaged bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelframe.llm.common import pieces, texts, with_text

PACKET = 188
ROOM = PACKET - 4
UNIT = 4096
RANDOM_ACCESS = 4
#: Fixed values of the format: sync byte, stream type and stream id of private data, table ids, ticks of a 25th second.
SYNC, PRIVATE_TYPE, PRIVATE_ID, PAT_ID, PMT_ID, TICKS = 0x47, 0x06, 0xBD, 0x00, 0x02, 3600
PROGRAM, MAP_PID, DATA_PID = 1, 0x100, 0x101


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    """CRC of table sections; 0 over a section with its CRC."""
    crc, rows = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ rows[crc >> 24 ^ b]
    return crc


def _packet(pid: int, counter: int, start: bool, payload: bytes, field: bytes | None = None) -> bytes:
    """One packet; field: adaptation bytes after the length. Short payloads get stuffing in the adaptation field."""
    short = ROOM - len(payload)
    if field is not None or short:
        field = field or b""
        stuffing = short - 1 - len(field)
        if stuffing > 0:
            field = (field or b"\x00") + b"\xff" * (stuffing - (0 if field else 1))
        adaptation = bytes([len(field)]) + field
    else:
        adaptation = b""
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | counter & 15]) + adaptation + payload


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(PAT_ID, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
    pmt = _section(PMT_ID, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    fill = lambda s: (b"\x00" + s).ljust(ROOM, b"\xff")
    return _packet(0, 0, True, fill(pat)) + _packet(MAP_PID, 0, True, fill(pmt))


def _stamp(ticks: int) -> bytes:
    """A presentation time in its five bytes with marker bits."""
    return bytes([0x21 | (ticks >> 29 & 0x0E), ticks >> 22 & 0xFF, 0x01 | (ticks >> 14 & 0xFE), ticks >> 7 & 0xFF, 0x01 | (ticks << 1 & 0xFE)])


def _clock(ticks: int) -> bytes:
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data, ticks = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        unit = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        field = b"\x50" + _clock(ticks) if k % RANDOM_ACCESS == 0 else None
        done = 0
        while done < len(unit):
            room = ROOM - (1 + len(field) if field else 0)
            out.append(_packet(DATA_PID, counter, done == 0, unit[done : done + room], field))
            done, counter, field = done + room, counter + 1, None
    return b"".join(out)


class Sections:
    """Table sections of one packet id, put together from as many packets as they take."""

    def __init__(self):
        self.held: bytearray | None = None

    def fed(self, data: bytes, start: bool) -> Iterator[bytes]:
        """The whole sections with a valid CRC that this packet's payload ends."""
        if not start:
            if self.held is not None:
                self.held += data
                yield from self._drained()
            return
        skip = 1 + data[0] if data else 0
        if self.held is not None:
            self.held += data[1:skip]
            yield from self._drained()
        self.held = bytearray(data[skip:])
        yield from self._drained()

    def _drained(self) -> Iterator[bytes]:
        while len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + (int.from_bytes(self.held[1:3], "big") & 0xFFF)
            if len(self.held) < size:
                return
            section = bytes(self.held[:size])
            del self.held[:size]
            if size >= 12 and section_crc(section) == 0:
                yield section


def _unit(data: bytes) -> tuple[int | None, bytes] | None:
    """Timestamp and payload of an elementary packet."""
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    size = int.from_bytes(data[4:6], "big")
    body = data[9 + data[8] : 6 + size if size else None]
    if size and len(data) < 6 + size:
        return None
    if data[7] & 0x80 and data[8] >= 5:
        p = data[9:14]
        return (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1, body
    return None, body


def read_stream(media: bytes) -> dict:
    """programs: {number: {pid: stream type}}; units: [(pid, timestamp, random access, payload)]; errors; packets."""
    packets = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    errors = int(len(media) % PACKET > 0)
    head = packets[:, :4].astype(np.int32)
    pid_of, counter_of = ((head[:, 1] & 0x1F) << 8 | head[:, 2]).tolist(), (head[:, 3] & 15).tolist()
    starts, controls, synced = (head[:, 1] & 0x40 > 0).tolist(), (head[:, 3] >> 4 & 3).tolist(), (head[:, 0] == SYNC).tolist()
    programs: dict[int, dict[int, int]] = {}
    maps: dict[int, int] = {}
    streams: set[int] = set()
    last: dict[int, int] = {}
    open_: dict[int, list] = {}
    units: list[tuple[int, int | None, bool, bytes]] = []
    tables: dict[int, Sections] = {0: Sections()}

    def close(pid: int) -> None:
        nonlocal errors
        if pid in open_:
            random, parts = open_.pop(pid)
            unit = _unit(b"".join(parts))
            if unit is None:
                errors += 1
            else:
                units.append((pid, unit[0], random, unit[1]))

    for k in range(len(packets)):
        pid, control = pid_of[k], controls[k]
        if not synced[k]:
            errors += 1
            continue
        if not control & 1 or pid == 0x1FFF:
            continue
        at, random = k * PACKET + 4, False
        if control & 2:
            size = media[at]
            random = size > 0 and bool(media[at + 1] & 0x40)
            at += 1 + size
        data = media[at : (k + 1) * PACKET]
        if pid in last:
            if counter_of[k] == last[pid]:
                continue  # a repeated packet
            if counter_of[k] != (last[pid] + 1) & 15:
                errors += 1
                open_.pop(pid, None)
                if pid in tables:
                    tables[pid].held = None
        last[pid] = counter_of[k]
        if pid == 0:
            for s in tables[0].fed(data, starts[k]):
                for i in range(8, len(s) - 4, 4):
                    number = int.from_bytes(s[i : i + 2], "big")
                    if number:
                        to = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
                        maps[to] = number
                        tables.setdefault(to, Sections())
        elif pid in maps:
            for s in tables[pid].fed(data, starts[k]):
                own = programs.setdefault(maps[pid], {})
                i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while i + 5 <= len(s) - 4:
                    own[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
                streams.update(own)
        elif pid in streams:
            if starts[k]:
                close(pid)
                open_[pid] = [random, [data]]
            elif pid in open_:
                open_[pid][1].append(data)
    for pid in list(open_):
        close(pid)
    return {"programs": programs, "units": units, "errors": errors, "packets": len(packets)}


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\x00" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


SCHEMA = "doc_id long, n_bytes long, media binary, units array<struct<pts: long, random_access: boolean, size: int>>"


def stored(documents: DataFrame, read_back: bool = True) -> DataFrame:
    """doc_id, n_bytes, the stream, and its timestamps with random-access points as read back (else null)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("size", pa.int32())]))
        for batch in pieces(batches):
            given = texts(batch)
            media = [write_stream(padded(x)) for x in given]
            units = [None] * len(media) if not read_back else [[{"pts": p, "random_access": r, "size": len(d)} for _, p, r, d in read_stream(m)["units"]] for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x.encode()) for x in given], pa.int64()), pa.array(media, pa.binary()), pa.array(units, kind)], ["doc_id", "n_bytes", "media", "units"])

    return with_text(documents).mapInArrow(rows, SCHEMA)


def described(media: bytes) -> tuple[bytes, str]:
    """The payload read back from a stream and its feature string."""
    got = read_stream(media)
    payload = b"".join(d for _, _, _, d in got["units"])
    stamps = [p for _, p, _, _ in got["units"] if p is not None]
    streams = "/".join(f"{n}.{pid}.{kind}" for n, own in sorted(got["programs"].items()) for pid, kind in sorted(own.items()))
    total = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))
    feature = f"ts;streams={streams};packets={got['packets']};errors={got['errors']};units={len(got['units'])};random={sum(r for _, _, r, _ in got['units'])};pts={stamps[0] if stamps else ''}-{stamps[-1] if stamps else ''};sum={total}"
    return payload, feature


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(documents: DataFrame) -> DataFrame:
    """What the stored streams hold, read back from their bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            out = []
            for doc, size, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload, feature = described(media)
                out.append((doc, size, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return stored(documents, read_back=False).select("doc_id", "n_bytes", "media").mapInArrow(rows, DIGESTS)
