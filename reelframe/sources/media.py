"""Media and subtitle files, or binary columns that hold them, as rows of streams with fields.

A file is scored by every registered format from its head, its extension and its size; candidates are tried by score,
ties in registry order, and the first that parses gives the streams. An unknown file has its General row alone.
Detection reads the first HEAD bytes, parsing the whole file, which its row of binary content holds in memory anyway.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions.text import utc_text
from reelframe.sources import more, tags

Fields = dict[str, object]
Streams = list[tuple[str, Fields]]
HEAD = 64 * 1024
SCHEMA = "file string, format string, score int, kind string, idx int, fields map<string,string>"


def be(b: bytes, at: int, n: int) -> int | None:
    return int.from_bytes(b[at : at + n], "big") if at + n <= len(b) else None


def le(b: bytes, at: int, n: int) -> int | None:
    return int.from_bytes(b[at : at + n], "little") if at + n <= len(b) else None


def ms(samples: int, rate: float) -> int | None:
    return int(samples * 1000 / rate + 0.5) if rate else None


def extended(b: bytes) -> float:
    """The 80-bit float of AIFF headers."""
    exponent, mantissa = struct.unpack(">HQ", b[:10])
    return (-1 if exponent & 0x8000 else 1) * mantissa * 2.0 ** ((exponent & 0x7FFF) - 16446)


def chunks(b: bytes, at: int, order: str, pad: bool = True) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of chunks of a name and four bytes of size."""
    while at + 8 <= len(b):
        size = int.from_bytes(b[at + 4 : at + 8], order)
        yield b[at : at + 4], at + 8, size
        at += 8 + size + (size & 1 if pad else 0)


def boxes(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of ISO boxes."""
    while at + 8 <= end:
        size, head = int.from_bytes(b[at : at + 4], "big"), 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield b[at + 4 : at + 8], at + head, min(at + size, end)
        at += size


# Images


def png(b: bytes) -> Streams | None:
    if not b.startswith(b"\x89PNG\r\n\x1a\n") or b[12:16] != b"IHDR" or len(b) < 29:
        return None
    width, height, depth, colour = struct.unpack(">IIBB", b[16:26])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not width or not height or depth not in (1, 2, 4, 8, 16) or not channels:
        return None
    return [("Image", {"Format": "PNG", "Width": width, "Height": height, "BitDepth": depth * channels, "ColorSpace": {0: "Y", 4: "YA", 6: "RGBA"}.get(colour, "RGB"), "Compression_Mode": "Lossless"})]


def gif(b: bytes) -> Streams | None:
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        return None
    width, height = struct.unpack("<HH", b[6:10])
    return [("Image", {"Format": "GIF", "Format_Profile": b[3:6].decode(), "Width": width, "Height": height, "Compression_Mode": "Lossless"})] if width and height else None


def bmp(b: bytes) -> Streams | None:
    if b[:2] != b"BM" or len(b) < 30:
        return None
    size = le(b, 14, 4)
    width, height, depth = struct.unpack("<HH2xH", b[18:26]) if size == 12 else struct.unpack("<ii2xH", b[18:30])
    return [("Image", {"Format": "RGB", "Width": width, "Height": abs(height), "BitDepth": depth})] if width > 0 and height else None


def jpeg(b: bytes) -> Streams | None:
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 < len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        marker = b[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            depth, height, width, parts = struct.unpack(">BHHB", b[at + 4 : at + 10])
            return [("Image", {"Format": "JPEG", "Width": width, "Height": height, "BitDepth": depth, "ColorSpace": {1: "Y", 3: "YUV", 4: "CMYK"}.get(parts), "Compression_Mode": "Lossy"})]
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None


def tiff(b: bytes) -> Streams | None:
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(b[:4])
    if not order:
        return None
    read = lambda at, n: int.from_bytes(b[at : at + n], order)
    at, found = read(4, 4), {}
    for k in range(read(at, 2) if at + 2 <= len(b) else 0):
        tag, kind = read(at + 2 + 12 * k, 2), read(at + 4 + 12 * k, 2)
        found[tag] = read(at + 10 + 12 * k, 2 if kind == 3 else 4)
    return [("Image", {"Format": "TIFF", "Width": found[256], "Height": found[257], "BitDepth": found.get(258)})] if found.get(256) and found.get(257) else None


def webp(b: bytes) -> Streams | None:
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        return None
    for name, at, _ in chunks(b, 12, "little"):
        if name == b"VP8 " and b[at + 3 : at + 6] == b"\x9d\x01\x2a":
            return [("Image", {"Format": "WebP", "Width": le(b, at + 6, 2) & 0x3FFF, "Height": le(b, at + 8, 2) & 0x3FFF, "Compression_Mode": "Lossy"})]
        if name == b"VP8L" and len(b) >= at + 5:
            bits = le(b, at + 1, 4)
            return [("Image", {"Format": "WebP", "Width": (bits & 0x3FFF) + 1, "Height": (bits >> 14 & 0x3FFF) + 1, "Compression_Mode": "Lossless"})]
        if name == b"VP8X" and len(b) >= at + 10:
            return [("Image", {"Format": "WebP", "Width": le(b, at + 4, 3) + 1, "Height": le(b, at + 7, 3) + 1})]
    return None


# Sound


def info_tags(b: bytes) -> Fields:
    """Tags of a RIFF file's INFO lists."""
    own = [(at, size) for name, at, size in chunks(b, 12, "little") if name == b"LIST" and b[at : at + 4] == b"INFO"]
    return tags.riff_info([(n, b[i : i + k]) for at, size in own for n, i, k in chunks(b[: at + size], at + 4, "little")])


def wave(b: bytes) -> Streams | None:
    if b[:4] not in (b"RIFF", b"RF64") or b[8:12] != b"WAVE":
        return None
    out: Fields = {}
    for name, at, size in chunks(b, 12, "little"):
        if name == b"fmt " and size >= 16 and len(b) >= at + 16:
            tag, channels, rate, per_second, align, depth = struct.unpack("<HHIIHH", b[at : at + 16])
            out |= {"Format": {1: "PCM", 3: "PCM", 6: "ADPCM", 0x55: "MPEG Audio", 0xFF: "AAC"}.get(tag, f"{tag:X}"), "CodecID": f"{tag:X}", "Channel(s)": channels, "SamplingRate": rate, "BitDepth": depth, "BitRate": per_second * 8, "_align": align}
        elif name == b"data" and out:
            out |= {"StreamSize": size, "Duration": ms(size // out["_align"], out["SamplingRate"]) if out["CodecID"] in "13" and out["_align"] else ms(size, out["BitRate"] / 8)}
            break
    out.pop("_align", None)
    general = info_tags(b)
    return [*([("General", general)] if general else []), ("Audio", out)] if out else None


def avi(b: bytes) -> Streams | None:
    if b[:4] != b"RIFF" or b[8:12] not in (b"AVI ", b"AVIX"):
        return None
    out: Streams = []

    def walk(at: int, end: int) -> None:
        for name, start, size in chunks(b[:end], at, "little"):
            if name == b"LIST" and b[start : start + 4] in (b"hdrl", b"strl"):
                walk(start + 4, min(end, start + size))
            elif name == b"strh" and size >= 36 and len(b) >= start + 36:
                kind, handler = b[start : start + 4], b[start + 4 : start + 8].decode("latin-1").strip("\0 ")
                scale, rate, _, length = struct.unpack("<IIII", b[start + 20 : start + 36])
                label = {b"vids": "Video", b"auds": "Audio", b"txts": "Text"}.get(kind)
                if label and scale and rate:
                    out.append((label, {"CodecID": handler, "Duration": ms(length * scale, rate), "FrameRate": f"{rate / scale:.3f}" if label == "Video" else None, "FrameCount": length if label == "Video" else None}))
            elif name == b"strf" and out and size >= 16 and len(b) >= start + 16:
                if out[-1][0] == "Video":
                    out[-1][1].update({"Width": le(b, start + 4, 4), "Height": abs(struct.unpack("<i", b[start + 8 : start + 12])[0]), "Format": b[start + 16 : start + 20].decode("latin-1")})
                elif out[-1][0] == "Audio":
                    out[-1][1].update({"CodecID": f"{le(b, start, 2):X}", "Channel(s)": le(b, start + 2, 2), "SamplingRate": le(b, start + 4, 4), "BitRate": le(b, start + 8, 4) * 8})

    walk(12, len(b))
    general = info_tags(b)
    return [*([("General", general)] if general else []), *out] if out else None


def aiff(b: bytes) -> Streams | None:
    if b[:4] != b"FORM" or b[8:12] not in (b"AIFF", b"AIFC"):
        return None
    for name, at, size in chunks(b, 12, "big"):
        if name == b"COMM" and size >= 18 and len(b) >= at + 18:
            channels, frames, depth = struct.unpack(">hIh", b[at : at + 8])
            rate = extended(b[at + 8 : at + 18])
            return [("Audio", {"Format": "PCM", "Channel(s)": channels, "SamplingRate": int(rate), "BitDepth": depth, "BitRate": int(rate) * channels * depth, "Duration": f"{frames / rate * 1000:.3f}" if rate else None})]
    return None


def au(b: bytes) -> Streams | None:
    if b[:4] != b".snd" or len(b) < 24:
        return None
    offset, size, encoding, rate, channels = struct.unpack(">IIIII", b[4:24])
    depth = {1: 8, 2: 8, 3: 16, 4: 24, 5: 32, 6: 32, 7: 64, 27: 8}.get(encoding)
    if offset < 24 or not depth or not rate or not channels:
        return None
    rate_bits = rate * channels * depth
    return [("Audio", {"Format": {1: "ADPCM", 27: "ADPCM"}.get(encoding, "PCM"), "Channel(s)": channels, "SamplingRate": rate, "BitDepth": depth, "BitRate": rate_bits, "Duration": None if size == 0xFFFFFFFF else ms(size * 8, rate_bits)})]


def caf(b: bytes) -> Streams | None:
    if b[:4] != b"caff":
        return None
    at, out = 8, {}
    while at + 12 <= len(b):
        name, size = b[at : at + 4], struct.unpack(">q", b[at + 4 : at + 12])[0]
        if name == b"desc" and at + 44 <= len(b):
            rate, = struct.unpack(">d", b[at + 12 : at + 20])
            packet, frames, channels, depth = struct.unpack(">IIII", b[at + 28 : at + 44])
            out = {"Format": {b"lpcm": "PCM", b"aac ": "AAC", b"alac": "ALAC"}.get(b[at + 20 : at + 24], b[at + 20 : at + 24].decode("latin-1")), "Channel(s)": channels, "SamplingRate": int(rate), "BitDepth": depth or None, "_packet": packet, "_frames": frames}
        elif name == b"data" and out and size > 4 and out["_packet"]:
            out["Duration"] = ms((size - 4) // out["_packet"] * out["_frames"], out["SamplingRate"])
        if size < 0:
            break
        at += 12 + size
    return [("Audio", {k: v for k, v in out.items() if k[0] != "_"})] if out else None


def flac(b: bytes) -> Streams | None:
    general, start = tags.id3v2(b)
    b = b[start:]
    if b[:4] != b"fLaC" or len(b) < 26 or b[4] & 0x7F:
        return None
    packed = int.from_bytes(b[18:26], "big")
    rate, channels, depth, samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    at, last = 4, False
    while not last and at + 4 <= len(b):  # metadata blocks
        last, kind, size = b[at] > 127, b[at] & 127, be(b, at + 1, 3)
        if kind == 4:
            general |= tags.vorbis(b[at + 4 : at + 4 + size])
        at += 4 + size
    length = ms(samples, rate) if samples else None
    sound = {"Format": "FLAC", "Channel(s)": channels, "SamplingRate": rate, "BitDepth": depth, "Duration": length, "Compression_Mode": "Lossless", "Encoded_Library": general.pop("Encoded_Library", None)}
    if length and at < len(b):
        sound |= {"StreamSize": len(b) - at, "BitRate": int((len(b) - at) * 8000 / length + 0.5)}
    return [*([("General", general)] if general else []), ("Audio", sound)] if rate else None


def tta(b: bytes) -> Streams | None:
    if b[:4] != b"TTA1" or len(b) < 18:
        return None
    channels, depth, rate, samples = struct.unpack("<HHII", b[6:18])
    return [("Audio", {"Format": "TTA", "Channel(s)": channels, "SamplingRate": rate, "BitDepth": depth, "Duration": ms(samples, rate), "Compression_Mode": "Lossless"})] if channels and rate else None


def amr(b: bytes) -> Streams | None:
    wide = b.startswith(b"#!AMR-WB\n")
    if not wide and not b.startswith(b"#!AMR\n"):
        return None
    sizes = [17, 23, 32, 36, 40, 46, 50, 58, 60, 5] if wide else [12, 13, 15, 17, 19, 20, 26, 31, 5]
    at, frames, kinds = 9 if wide else 6, 0, set()
    while at < len(b) and (b[at] >> 3 & 15) < len(sizes):
        kinds.add(b[at] >> 3 & 15)
        at += 1 + sizes[b[at] >> 3 & 15]
        frames += 1
    rate = f"{(1 + sizes[next(iter(kinds))]) * 400}" if len(kinds) == 1 else None
    return [("Audio", {"Format": "AMR", "Format_Profile": "Wide band" if wide else "Narrow band", "Channel(s)": 1, "SamplingRate": 16000 if wide else 8000, "Duration": f"{frames * 20:.3f}", "BitRate": rate, "BitRate_Mode": "CBR" if rate else "VBR"})] if frames else None


#: Sampling rates of AAC and bit rates (kbit/s) of MPEG-1 layers 1 to 3 and MPEG-2 layers 1 and 2/3.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
MPEG_RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384], (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
AC3_KBITS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]


def adts(b: bytes) -> Streams | None:
    at, frames, sizes, first = 0, 0, set(), None
    while at + 7 <= len(b) and b[at] == 0xFF and b[at + 1] & 0xF6 == 0xF0:
        size = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5
        index = b[at + 2] >> 2 & 15
        if size < 7 or index >= len(AAC_RATES):
            break
        first = first or (AAC_RATES[index], (b[at + 2] & 1) << 2 | b[at + 3] >> 6, b[at + 2] >> 6)
        sizes.add(size)
        frames, at = frames + 1, at + size
    if frames < 2:
        return None
    rate, channels, profile = first
    constant = len(sizes) == 1
    return [("Audio", {"Format": "AAC", "Format_AdditionalFeatures": ["Main", "LC", "SSR", "LTP"][profile], "Channel(s)": channels or None, "SamplingRate": rate, "FrameCount": frames, "BitRate_Mode": "CBR" if constant else "VBR", "BitRate": at * 8 * rate // (frames * 1024) if constant else None})]


def mpeg_header(b: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """version, layer, bit rate, sampling rate, frame size, channels."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(b[at + 1] >> 3 & 3), {3: 1, 2: 2, 1: 3}.get(b[at + 1] >> 1 & 3)
    kbits, index = b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if not version or not layer or index == 3 or kbits in (0, 15):
        return None
    rate = [44100, 48000, 32000][index] // {1: 1, 2: 2, 25: 4}[version]
    bits = MPEG_RATES[(1, layer) if version == 1 else (2, min(layer, 2))][kbits] * 1000
    padding = b[at + 2] >> 1 & 1
    size = (12 * bits // rate + padding) * 4 if layer == 1 else (72 if layer == 3 and version != 1 else 144) * bits // rate + padding
    return version, layer, bits, rate, size, 1 if b[at + 3] >> 6 == 3 else 2


def mpeg_audio(b: bytes) -> Streams | None:
    general, at = tags.id3v2(b)
    general = tags.id3v1(b) | tags.apev2(b) | general
    head = first = mpeg_header(b, at)
    frames, sizes = 0, set()
    while head and head[:2] == first[:2] and head[3] == first[3]:
        frames, at = frames + 1, at + head[4]
        sizes.add(head[2])
        head = mpeg_header(b, at)
    if frames < 2:
        return None
    version, layer, bits, rate, _, channels = first
    per = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    return [*([("General", general)] if general else []), ("Audio", {"Format": "MPEG Audio", "Format_Version": f"Version {2.5 if version == 25 else version}", "Format_Profile": f"Layer {layer}", "Channel(s)": channels, "SamplingRate": rate, "BitRate_Mode": "CBR" if len(sizes) == 1 else "VBR", "BitRate": bits if len(sizes) == 1 else None, "FrameCount": frames, "Duration": int(frames * per * 1000 / rate)})]


def ac3(b: bytes) -> Streams | None:
    at, frames, first = 0, 0, None
    while at + 7 <= len(b) and b[at : at + 2] == b"\x0b\x77" and b[at + 5] >> 3 <= 8:
        code, index = b[at + 4] >> 6, (b[at + 4] & 63) >> 1
        if code == 3 or index >= len(AC3_KBITS):
            break
        rate, kbits = [48000, 44100, 32000][code], AC3_KBITS[index]
        mode = b[at + 6] >> 5
        shift = 4 - 2 * bool(mode & 1 and mode != 1) - 2 * bool(mode & 4) - 2 * (mode == 2)
        low = b[at + 6] >> max(shift, 0) & 1 if shift >= 0 else 0
        first = first or (rate, kbits, [2, 1, 2, 3, 3, 4, 4, 5][mode] + low)
        size = {48000: 2 * kbits * 2, 32000: 3 * kbits * 2, 44100: (kbits * 96000 // 44100 + (b[at + 4] & 1)) * 2}[rate]
        frames, at = frames + 1, at + size
    if frames < 2:
        return None
    return [("Audio", {"Format": "AC-3", "Channel(s)": first[2], "SamplingRate": first[0], "BitRate": first[1] * 1000, "BitRate_Mode": "CBR", "Duration": ms(frames * 1536, first[0])})]


# Containers


def ivf(b: bytes) -> Streams | None:
    if b[:4] != b"DKIF" or len(b) < 32:
        return None
    head, code, width, height, rate, scale = struct.unpack("<H4sHHII", b[6:24])
    at, frames, payload = head, 0, 0
    while at + 12 <= len(b):
        size = le(b, at, 4)
        frames, payload, at = frames + 1, payload + size, at + 12 + size
    duration = ms(frames * scale, rate)
    return [("Video", {"Format": code.decode("latin-1"), "CodecID": code.decode("latin-1"), "Width": width, "Height": height, "FrameRate": f"{rate / scale:.3f}" if scale else None, "FrameCount": frames, "Duration": duration, "StreamSize": payload, "BitRate": int(payload * 8000 / duration + 0.5) if duration else None})]


def item_tags(b: bytes, at: int, end: int) -> Fields:
    """Tags of a movie's item list (udta, meta, ilst)."""
    items = []
    for kind, s, e in boxes(b, at, end):
        if kind in (b"udta", b"meta", b"ilst"):
            skip = 4 if kind == b"meta" and b[s : s + 4] == b"\0\0\0\0" else 0
            if kind != b"ilst":
                items.append(item_tags(b, s + skip, e))
                continue
            own = []
            for name, i, j in boxes(b, s, e):
                parts = {k: (p, q) for k, p, q in boxes(b, i, j)}
                if b"data" in parts:
                    p, q = parts[b"data"]
                    full = ":".join(["----", *(b[x + 4 : y].decode("utf-8", "replace") for x, y in (parts[n] for n in (b"mean", b"name") if n in parts))]) if name == b"----" else name.decode("latin-1")
                    own.append((full, be(b, p, 4) & 0xFFFFFF, b[p + 8 : q]))
            items.append(tags.mp4_items(own))
    return {k: v for own in items for k, v in own.items()}


def mp4(b: bytes) -> Streams | None:
    out: Streams = []
    movie = next(((s, e) for t, s, e in boxes(b, 0, len(b)) if t == b"moov"), None)
    if not movie:
        return None

    def find(at: int, end: int, *names: bytes) -> tuple[int, int] | None:
        for name in names:
            got = next(((s, e) for t, s, e in boxes(b, at, end) if t == name), None)
            if not got:
                return None
            at, end = got
        return at, end

    for kind, at, end in boxes(b, *movie):
        if kind != b"trak":
            continue
        handler, times, table = find(at, end, b"mdia", b"hdlr"), find(at, end, b"mdia", b"mdhd"), find(at, end, b"mdia", b"minf", b"stbl")
        if not handler or not times:
            continue
        label = {b"vide": "Video", b"soun": "Audio", b"text": "Text", b"sbtl": "Text", b"tmcd": "Other"}.get(b[handler[0] + 8 : handler[0] + 12])
        wide = b[times[0]] == 1
        scale, length = be(b, times[0] + (20 if wide else 12), 4), be(b, times[0] + (24 if wide else 16), 8 if wide else 4)
        code = be(b, times[0] + (32 if wide else 20), 2) or 0
        fields: Fields = {"Duration": ms(length, scale) if scale else None, "Language": "".join(chr(0x60 + (code >> s & 31)) for s in (10, 5, 0)) if code else None}
        described = find(*table, b"stsd") if table else None
        if described and described[0] + 16 <= described[1]:
            entry = described[0] + 8
            fields["CodecID"] = b[entry + 4 : entry + 8].decode("latin-1")
            if label == "Video":
                fields |= {"Width": be(b, entry + 32, 2), "Height": be(b, entry + 34, 2)}
            elif label == "Audio":
                fields |= {"Channel(s)": be(b, entry + 24, 2), "BitDepth": be(b, entry + 26, 2), "SamplingRate": be(b, entry + 32, 2)}
        counted = find(*table, b"stts") if table else None
        if counted:
            runs = [struct.unpack(">II", b[p : p + 8]) for p in range(counted[0] + 8, min(counted[1], counted[0] + 8 + 8 * (be(b, counted[0] + 4, 4) or 0)) - 7, 8)]
            samples, ticks = sum(n for n, _ in runs), sum(n * d for n, d in runs)
            if label == "Video" and ticks and scale:
                fields |= {"FrameCount": samples, "FrameRate": f"{scale / runs[0][1] if len(runs) == 1 else samples * scale / ticks:.3f}", "FrameRate_Mode": "CFR" if len(runs) == 1 or (len(runs) == 2 and runs[1][0] == 1) else "VFR"}
        if label:
            out.append((label, fields))
    general = item_tags(b, *movie)
    return [*([("General", general)] if general else []), *out]


def ebml(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of EBML elements; unknown sizes run to the end."""
    while at < end and b[at]:
        width = 9 - b[at].bit_length()
        if width > 4 or at + width >= end:
            return
        name = int.from_bytes(b[at : at + width], "big")
        at += width
        if not b[at]:
            return
        width = 9 - b[at].bit_length()
        size = int.from_bytes(b[at : at + width], "big") & (1 << 7 * width) - 1
        unknown = size == (1 << 7 * width) - 1
        at += width
        stop = end if unknown else min(end, at + size)
        yield name, at, stop
        at = stop if unknown else at + size


#: Element ids of Matroska.
_SEGMENT, _INFO, _TRACKS, _TRACK = 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE


def matroska(b: bytes) -> Streams | None:
    if b[:4] != b"\x1a\x45\xdf\xa3":
        return None
    whole = lambda s, e: int.from_bytes(b[s:e], "big")
    real = lambda s, e: struct.unpack(">f" if e - s == 4 else ">d", b[s:e])[0] if e - s in (4, 8) else 0.0
    out: Streams = []
    scale, duration = 1_000_000, 0.0
    for name, at, end in ebml(b, 0, len(b)):
        if name != _SEGMENT:
            continue
        for part, s, e in ebml(b, at, end):
            if part == _INFO:
                for x, i, j in ebml(b, s, e):
                    scale, duration = (whole(i, j), duration) if x == 0x2AD7B1 else (scale, real(i, j)) if x == 0x4489 else (scale, duration)
            elif part == _TRACKS:
                for x, i, j in ebml(b, s, e):
                    if x != _TRACK:
                        continue
                    own = {k: (p, q) for k, p, q in ebml(b, i, j)}
                    label = {1: "Video", 2: "Audio", 0x11: "Text"}.get(whole(*own[0x83])) if 0x83 in own else None
                    fields: Fields = {"CodecID": b[slice(*own[0x86])].decode("latin-1") if 0x86 in own else None, "Language": b[slice(*own[0x22B59C])].decode("latin-1").strip("\0") if 0x22B59C in own else None}
                    if 0x23E383 in own and label == "Video" and whole(*own[0x23E383]):
                        fields["FrameRate"] = f"{1e9 / whole(*own[0x23E383]):.3f}"
                    if 0xE0 in own:
                        video = {k: whole(p, q) for k, p, q in ebml(b, *own[0xE0])}
                        fields |= {"Width": video.get(0xB0), "Height": video.get(0xBA)}
                    if 0xE1 in own:
                        sound = {k: (p, q) for k, p, q in ebml(b, *own[0xE1])}
                        fields |= {"SamplingRate": int(real(*sound[0xB5])) if 0xB5 in sound else 8000, "Channel(s)": whole(*sound[0x9F]) if 0x9F in sound else 1}
                    if label:
                        out.append((label, fields))
    return [("General", {"Duration": int(duration * scale / 1e6 + 0.5) or None}), *out]


def ogg(b: bytes) -> Streams | None:
    at, out, last, general = 0, {}, {}, {}
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b):
        granule, serial = struct.unpack("<qI", b[at + 6 : at + 18])
        count = b[at + 26]
        body = at + 27 + count
        size = sum(b[at + 27 : body])
        data = b[body : body + size]
        if b[at + 5] & 2:
            if data[:7] == b"\x01vorbis":
                out[serial] = ("Audio", {"Format": "Vorbis", "Channel(s)": data[11], "SamplingRate": le(data, 12, 4)})
            elif data[:8] == b"OpusHead":
                out[serial] = ("Audio", {"Format": "Opus", "Channel(s)": data[9], "SamplingRate": 48000})
            elif data[:5] == b"\x7fFLAC" and (inner := flac(data[9:])):
                out[serial] = inner[0]
            elif data[:7] == b"\x80theora" and len(data) >= 30:
                out[serial] = ("Video", {"Format": "Theora", "Width": be(data, 14, 3), "Height": be(data, 17, 3), "FrameRate": f"{be(data, 22, 4) / max(1, be(data, 26, 4)):.3f}"})
        else:
            for mark in (b"\x03vorbis", b"OpusTags", b"\x81theora"):
                if data.startswith(mark):
                    general = tags.vorbis(data[len(mark) :]) | general
        if granule >= 0:
            last[serial] = granule
        at = body + size
    for serial, (kind, fields) in out.items():
        if kind == "Audio" and serial in last:
            fields["Duration"] = ms(last[serial], fields["SamplingRate"])
    return [*([("General", general)] if general else []), *out.values()] if out else None


def flv(b: bytes) -> Streams | None:
    if b[:3] != b"FLV" or len(b) < 13:
        return None
    at, times, fields = be(b, 5, 4) + 4, {8: [], 9: []}, {}
    while at + 11 <= len(b):
        kind, size = b[at] & 31, be(b, at + 1, 3)
        if kind in times and size and at + 11 < len(b):
            times[kind].append(be(b, at + 4, 3) | b[at + 7] << 24)
            first = b[at + 11]
            fields.setdefault(kind, {"Format": {2: "MPEG Audio", 10: "AAC"}.get(first >> 4, "PCM"), "SamplingRate": 5512 << (first >> 2 & 3) if first >> 2 & 3 else 5512, "Channel(s)": 1 + (first & 1)} if kind == 8 else {"Format": {2: "Sorenson Spark", 4: "VP6", 7: "AVC"}.get(first & 15)})
        at += 11 + size + 4
    out = []
    for kind, label in ((9, "Video"), (8, "Audio")):
        if own := times[kind]:
            steps = sorted(y - x for x, y in zip(own, own[1:], strict=False) if y > x)
            tick = steps[len(steps) // 2] if steps else 0
            out.append((label, fields[kind] | {"Duration": own[-1] - own[0] + tick, "FrameCount": len(own) if kind == 9 else None, "FrameRate": f"{1000 / tick:.3f}" if kind == 9 and tick else None}))
    return out or None


# Subtitles


def decoded(b: bytes) -> str | None:
    """Text of UTF-8 (a cut last character is allowed) or UTF-16 with a mark; control characters aren't text."""
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = b[: len(b) // 2 * 2].decode("utf-16", "replace")
    else:
        b = b.removeprefix(b"\xef\xbb\xbf")
        try:
            text = b.decode()
        except UnicodeDecodeError as x:
            if x.start < len(b) - 3:
                return None
            text = b[: x.start].decode()
    return None if re.search(r"[\x00-\x08\x0e-\x1f]", text) else text


_CUES = {
    "SubRip": re.compile(r"(?m)^\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"),
    "WebVTT": re.compile(r"(?m)^\s*(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})\s*-->\s*(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})"),
    "ASS": re.compile(r"(?m)^Dialogue:[^,]*,\s*(\d+):(\d{1,2}):(\d{1,2})\.(\d{1,3})\s*,\s*(\d+):(\d{1,2}):(\d{1,2})\.(\d{1,3})"),
}


def cues(text: str, kind: str) -> list[tuple[int, int]]:
    """Begin and end of each cue in milliseconds; cues that end before they begin are left out."""
    value = lambda g: ((int(g[0] or 0) * 60 + int(g[1])) * 60 + int(g[2])) * 1000 + int(g[3].ljust(3, "0"))
    found = [(value(m.groups()[:4]), value(m.groups()[4:])) for m in _CUES[kind].finditer(text) if max(map(int, m.group(2, 3, 6, 7))) <= 59]
    return [x for x in found if x[1] >= x[0]]


def _subtitle(b: bytes, name: str, kind: str) -> Streams | None:
    text = decoded(b)
    if text is None:
        return None
    found = cues(text.replace("\r\n", "\n"), kind)
    return [("Text", {"Format": name, "ElementCount": len(found), "Duration": max(e for _, e in found) if found else None, "Delay": min(s for s, _ in found) if found else None})]


def srt(b: bytes) -> Streams | None:
    return _subtitle(b, "SubRip", "SubRip")


def vtt(b: bytes) -> Streams | None:
    return _subtitle(b, "WebVTT", "WebVTT")


def ass(b: bytes) -> Streams | None:
    text = decoded(b) or ""
    return _subtitle(b, "ASS" if "v4.00+" in text.lower() else "SSA", "ASS")


def vobsub(b: bytes) -> Streams | None:
    text = decoded(b)
    if text is None:
        return None
    size = re.search(r"(?m)^size:\s*(\d+)x(\d+)", text)
    out, current = [], None
    for line in text.splitlines():
        if m := re.match(r"id:\s*(\w+)?,\s*index:\s*(\d+)", line):
            current = {"Format": "VobSub", "ID": m[2], "Language": m[1], "ElementCount": 0, "Width": size and size[1], "Height": size and size[2]}
            out.append(("Text", current))
        elif current and (m := re.match(r"timestamp:\s*(\d+):(\d{2}):(\d{2}):(\d{3})", line)):
            current["ElementCount"] += 1
            current["Duration"] = ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4])
    return out or None


# Detection

Probe = Callable[[bytes, str, int], int]


def _magic(*magics: bytes, score: int = 100) -> Probe:
    return lambda head, ext, size: score if head.startswith(magics) else 0


def _chained(test: Callable[[bytes], bool], exts: tuple[str, ...], strong: int = 70) -> Probe:
    return lambda head, ext, size: (95 if ext in exts else strong) if test(head) else 20 if ext in exts else 0


def _is_mp4(head: bytes, ext: str, size: int) -> int:
    kind, length = head[4:8], be(head, 0, 4)
    if kind == b"jP  " or head[4:12] == b"ftypjp2 " or length is None or (length < 8 and length not in (0, 1)):
        return 0
    return 100 if kind == b"ftyp" else 80 if kind in (b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot", b"moof", b"styp", b"sidx", b"uuid") else 0


def _is_cue(head: bytes) -> bool:
    text = decoded(head)
    return text is not None and bool(re.match(r"\s*(?:\d+\s*\n)?\s*\d+:\d{1,2}:\d{1,2}[,.]\d{1,3}\s*-->", text.replace("\r\n", "\n")))


def _is_ass(head: bytes, ext: str, size: int) -> int:
    text = (decoded(head) or "").lstrip()
    return 100 if text.startswith("[Script Info]") else 70 if ext in ("ass", "ssa") and "[Events]" in text and "Dialogue:" in text else 0


def _is_transport(head: bytes, ext: str, size: int) -> int:
    shape = more.packet_size(head)
    if not shape:
        return 0
    return 100 if ext in ("ts", "m2t", "m2ts", "mts", "tp", "trp", "tmf") else 90 if shape == (188, 0) else 85


def _is_annex_b(kind: Callable[[bytes], int], needed: set[int], exts: tuple[str, ...]) -> Probe:
    """Start codes from the beginning on, and all parameter sets in the first 4 KiB."""

    def probe(head: bytes, ext: str, size: int) -> int:
        if not re.match(rb"\x00{2,3}\x01", head):
            return 0
        own = [u for u in more.units(head[:4096]) if u and not u[0] & 128]
        if needed <= {kind(u) for u in own}:
            return 95 if ext in exts else 70
        return 40 if ext in exts and len(own) > 1 else 0

    return probe


def ext_score(magic: Column, ext: Column) -> Column:
    """Score of a format with and without its magic bytes and its extension."""
    return F.when(magic & ext, 90).when(magic, 60).when(ext, 20).otherwise(0)


#: What a probe or parser may raise on bytes that are cut off or damaged; the file then tells the first in ParseError.
DAMAGE = (IndexError, struct.error, TypeError, ValueError, ZeroDivisionError, OverflowError, KeyError, EOFError)
#: In order: name, probe of (head, extension, size), parser.
REGISTRY: list[tuple[str, Probe, Callable[[bytes], Streams | None]]] = [
    ("Matroska", _magic(b"\x1a\x45\xdf\xa3"), matroska),
    ("MPEG-4", _is_mp4, mp4),
    ("WebP", lambda h, e, n: 100 if h[:4] == b"RIFF" and h[8:12] == b"WEBP" else 0, webp),
    ("Wave", lambda h, e, n: 100 if h[:4] in (b"RIFF", b"RF64") and h[8:12] == b"WAVE" else 0, wave),
    ("AVI", lambda h, e, n: 0 if h[:4] != b"RIFF" else 100 if h[8:12] == b"AVI " else 60 if h[8:12] == b"AVIX" else 0, avi),
    ("AIFF", lambda h, e, n: 100 if h[:4] == b"FORM" and h[8:12] in (b"AIFF", b"AIFC") else 0, aiff),
    ("AU", lambda h, e, n: 0 if h[:4] != b".snd" else 100 if (be(h, 4, 4) or 0) >= 24 and 1 <= (be(h, 12, 4) or 0) <= 27 else 60, au),
    ("CAF", lambda h, e, n: 0 if h[:4] != b"caff" else 100 if h[4:6] == b"\0\1" and h[8:12] == b"desc" else 70, caf),
    ("Ogg", lambda h, e, n: 100 if h[:5] == b"OggS\0" else 0, ogg),
    ("ASF", _magic(more.ASF_HEADER), more.asf),
    ("Flash Video", lambda h, e, n: 0 if h[:3] != b"FLV" else 100 if h[3:4] == b"\1" and be(h, 5, 4) == 9 else 70, flv),
    ("RealMedia", _magic(b".RMF"), more.real),
    ("MXF", lambda h, e, n: 100 if h.startswith(more.MXF_KEY) else 80 if more.MXF_KEY in h else 0, more.mxf),
    ("Nut", _magic(more.NUT_HEAD), more.nut),
    ("IVF", lambda h, e, n: 0 if h[:4] != b"DKIF" else 100 if h[4:8] == b"\0\0\x20\0" else 80, ivf),
    ("MPEG-TS", _is_transport, more.transport),
    ("MPEG-PS", lambda h, e, n: 0 if b"\0\0\1\xba" not in h else 60 if h[:4] != b"\0\0\1\xba" else 100 if e in ("mpeg", "mpg", "m2p", "vob", "vro", "pss", "evo") else 90, more.program),
    ("DV", _chained(lambda h: more.dv(h) is not None, ("dv", "dif")), more.dv),
    ("FLAC", lambda h, e, n: (100 if be(h, 5, 3) == 34 else 80) if h[:4] == b"fLaC" else 20 if e == "flac" else 0, flac),
    ("WavPack", lambda h, e, n: (100 if more.wavpack(h) else 40) if h[:4] == b"wvpk" else 20 if e in ("wv", "wvc") else 0, more.wavpack),
    ("TTA", lambda h, e, n: (100 if tta(h) else 40) if h[:4] == b"TTA1" else 20 if e == "tta" else 0, tta),
    ("Monkey's Audio", lambda h, e, n: (100 if more.ape(h) else 50) if h[:4] == b"MAC " else 20 if e in ("ape", "mac") else 0, more.ape),
    ("AMR", lambda h, e, n: 100 if h.startswith((b"#!AMR\n", b"#!AMR-WB\n")) else 10 if e == "amr" else 0, amr),
    ("MLP", lambda h, e, n: (60 if e in ("mlp", "thd") else 30) if more.mlp(h) else 0, more.mlp),
    ("AC-3", _chained(lambda h: ac3(h) is not None, ("ac3",)), ac3),
    ("DTS", _chained(lambda h: more.dts(h) is not None, ("dts", "dtshd")), more.dts),
    ("ADTS", _chained(lambda h: adts(h) is not None, ("aac", "adts")), adts),
    ("LATM", _chained(lambda h: more.latm(h) is not None, ("latm", "loas"), 65), more.latm),
    ("MPEG Audio", _chained(lambda h: mpeg_audio(h) is not None, ("mp1", "mp2", "mp3", "mpa")), mpeg_audio),
    ("AVC", _is_annex_b(lambda u: u[0] & 31, {7, 8}, ("avc", "h264", "264")), more.avc),
    ("HEVC", _is_annex_b(lambda u: u[0] >> 1 & 63, {32, 33, 34}, ("hevc", "h265", "265")), more.hevc),
    ("MPEG Video", lambda h, e, n: 0 if h[:4] != b"\0\0\1\xb3" or b"\0\0\1\0" not in h else 95 if e in ("mpgv", "mpv", "mp1v", "m1v", "mp2v", "m2v") else 60 if b"\0\0\1\xb8" in h or b"\0\0\1\xb5" in h else 0, more.mpeg_video),
    ("MPEG-4 Visual", lambda h, e, n: 0 if not re.match(rb"\x00\x00\x01[\xb0\xb5\x00-\x2f]", h) or not re.search(rb"\x00\x00\x01[\x20-\x2f]", h) or b"\0\0\1\xb6" not in h else 95 if e in ("m4v", "mp4v") else 60, more.mpeg4_visual),
    ("VC-3", lambda h, e, n: 0 if h[:4] != b"\0\0\2\x80" else 90 if e in ("dnxhd", "vc3") else 40, more.vc3),
    ("JPEG", lambda h, e, n: 100 if h[:3] == b"\xff\xd8\xff" else 60 if e in ("jpg", "jpeg") and h[:2] == b"\xff\xd8" else 0, jpeg),
    ("PNG", lambda h, e, n: 0 if h[:8] != b"\x89PNG\r\n\x1a\n" else 100 if h[12:16] == b"IHDR" else 80, png),
    ("GIF", _magic(b"GIF87a", b"GIF89a"), gif),
    ("Bitmap", lambda h, e, n: 0 if not bmp(h) else 100 if (le(h, 10, 4) or 0) <= n else 60, bmp),
    ("TIFF", lambda h, e, n: 0 if h[:4] not in (b"II*\0", b"MM\0*") else 100 if int.from_bytes(h[4:8], "little" if h[:1] == b"I" else "big") < n else 50, tiff),
    ("JPEG 2000", lambda h, e, n: 100 if h[:12] == b"\0\0\0\x0cjP  \r\n\x87\n" else 0 if h[:4] != b"\xff\x4f\xff\x51" else 100 if e in ("j2k", "j2c", "jpc") else 90, more.jpeg2000),
    ("SubRip", lambda h, e, n: 100 if _is_cue(h) else 0, srt),
    ("ASS/SSA", _is_ass, ass),
    ("WebVTT", lambda h, e, n: 100 if re.match(r"WEBVTT(?:\s|$)", decoded(h) or "") else 0, vtt),
    ("VobSub", lambda h, e, n: 100 if (decoded(h) or "").startswith("# VobSub index file") else 0, vobsub),
]


def scores(head: bytes, ext: str, size: int) -> list[tuple[str, int]]:
    """Formats with a score, best first, ties in registry order."""

    def score(probe: Probe) -> int:
        try:
            return probe(head, ext, size)
        except DAMAGE:
            return 0

    found = [(name, score(probe)) for name, probe, _ in REGISTRY]
    return sorted((x for x in found if x[1] > 0), key=lambda x: -x[1])


def parsed(name: str, data: bytes) -> tuple[str | None, int, Streams]:
    """Format, score and streams of a file; (None, 0, [General]) when no format takes it."""
    ext = name.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in name.rsplit("/", 1)[-1].lstrip(".") else ""
    parsers = {n: p for n, _, p in REGISTRY}
    failed: str | None = None
    for format_, score in scores(data[:HEAD], ext, len(data)):
        try:
            streams = parsers[format_](data)
        except DAMAGE as error:
            streams, failed = None, failed or f"{format_}: {type(error).__name__}"  # damaged beyond what the format's checks foresee
        if streams is not None:
            general = dict(next((f for k, f in streams if k == "General"), {}))
            return format_, score, [("General", {"Format": format_, "FileSize": len(data)} | general), *((k, f) for k, f in streams if k != "General")]
    return None, 0, [("General", {"FileSize": len(data), "StreamSize": len(data), "ParseError": failed})]


def stream_rows(files: DataFrame, name: str = "file", content: str = "content") -> DataFrame:
    """A row per stream of each file: file, format, score, kind, idx, fields."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                format_, score, streams = parsed(file or "", data or b"")
                seen: dict[str, int] = {}
                for kind, fields in streams:
                    seen[kind] = seen.get(kind, -1) + 1
                    out.append((file, format_, score, kind, seen[kind], [(k, str(v)) for k, v in fields.items() if v not in (None, "")]))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "format", "score", "kind", "idx", "fields"])

    return files.select(F.col(name).cast("string").alias("file"), F.col(content).alias("content")).mapInArrow(rows, SCHEMA)


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Stream rows of the files under a path, with Spark's own file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return stream_rows(files.select(F.col("path").alias("file"), "content"))


def list_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """path, size and modified (UTC text) of the files under the paths, sorted by path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths))
    modified = utc_text(F.unix_timestamp("modificationTime"))
    return files.select("path", F.col("length").alias("size"), modified.alias("modified")).orderBy("path")
