"""Elementary video streams, program and transport streams, Windows, Real and exchange containers, and lossless sound."""

from __future__ import annotations

import re
import struct

from reelframe.sources.bits import Bits, clean, unescaped, utf16

Fields = dict[str, object]
Streams = list[tuple[str, Fields]]
#: Profiles by number.
AVC_PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}
HEVC_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still", 4: "Format Range"}
CHROMA = {1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
#: Pixel aspect ratios and frame rates by code.
PIXEL_RATIOS = {1: (1, 1), 2: (12, 11), 3: (10, 11), 4: (16, 11), 5: (40, 33), 6: (24, 11), 7: (20, 11), 8: (32, 11), 9: (80, 33), 10: (18, 11), 11: (15, 11), 12: (64, 33), 13: (160, 99), 14: (4, 3), 15: (3, 2), 16: (2, 1)}
MPEG_RATES = {1: "23.976", 2: "24.000", 3: "25.000", 4: "29.970", 5: "30.000", 6: "50.000", 7: "59.940", 8: "60.000"}
#: Kind and format of a transport stream's stream types.
STREAM_TYPES = {1: ("Video", "MPEG Video"), 2: ("Video", "MPEG Video"), 3: ("Audio", "MPEG Audio"), 4: ("Audio", "MPEG Audio"), 15: ("Audio", "AAC"), 16: ("Video", "MPEG-4 Visual"), 17: ("Audio", "AAC"), 27: ("Video", "AVC"), 36: ("Video", "HEVC"), 128: ("Audio", "PCM"), 129: ("Audio", "AC-3"), 130: ("Audio", "DTS"), 131: ("Audio", "MLP FBA"), 135: ("Audio", "E-AC-3"), 144: ("Text", "PGS"), 234: ("Video", "VC-1")}
#: Sampling rates of WavPack and channels of DTS by code.
WAVPACK_RATES = [6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000]
DTS_RATES = [0, 8000, 16000, 32000, 0, 0, 11025, 22050, 44100, 0, 0, 12000, 24000, 48000]
DTS_CHANNELS = [1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 6, 6, 6, 7, 8, 8]
ASF_HEADER = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")
ASF_FILE, ASF_STREAM, ASF_CONTENT = (bytes.fromhex(x) for x in ("a1dcab8c47a9cf118ee400c00c205365", "9107dcb7b7a9cf118ee600c00c205365", "3326b2758e66cf11a6d900aa0062ce6c"))
ASF_AUDIO, ASF_VIDEO = (bytes.fromhex(x) for x in ("409e69f84d5bcf11a8fd00805f5c442b", "c0ef19bc4d5bcf11a8fd00805f5c442b"))
NUT_HEAD = b"nut/multimedia container\0"
MXF_KEY = bytes.fromhex("060e2b34020501010d010201")


def units(b: bytes, stuffed: bool = True) -> list[bytes]:
    """The units behind start codes 00 00 01, without the zeros that stuffing may put behind them."""
    parts = re.split(rb"\x00\x00\x01", b)[1:]
    return [p.rstrip(b"\0") if stuffed and k < len(parts) - 1 else p for k, p in enumerate(parts)]


def _timing(bits: Bits) -> str | None:
    """Frame rate of AVC's usability information, after the fields before it."""
    if bits.bits(1) and bits.bits(8) == 255:
        bits.bits(32)
    if bits.bits(1):
        bits.bits(1)
    if bits.bits(1):
        bits.bits(4)
        if bits.bits(1):
            bits.bits(24)
    if bits.bits(1):
        bits.ue(), bits.ue()
    if bits.bits(1):
        ticks, scale = bits.bits(32), bits.bits(32)
        return f"{scale / ticks / 2:.3f}" if ticks and scale else None
    return None


def avc_parameters(nal: bytes) -> Fields:
    """Fields of a sequence parameter set."""
    bits = Bits(unescaped(nal)[1:])
    profile, _, level = bits.bits(8), bits.bits(8), bits.bits(8)
    bits.ue()
    chroma, depth, separate = 1, 8, 0
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128, 138):
        chroma = bits.ue()
        separate = bits.bits(1) if chroma == 3 else 0
        depth = 8 + bits.ue()
        bits.ue(), bits.bits(1)
        if bits.bits(1):
            for k in range(12 if chroma == 3 else 8):
                if bits.bits(1):
                    last = following = 8
                    for _ in range(16 if k < 6 else 64):
                        following = (last + bits.se()) % 256 if following else 0
                        last = following or last
    bits.ue()
    order = bits.ue()
    if order == 0:
        bits.ue()
    elif order == 1:
        bits.bits(1), bits.se(), bits.se()
        for _ in range(bits.ue()):
            bits.se()
    references = bits.ue()
    bits.bits(1)
    width, height, frames = (bits.ue() + 1) * 16, (bits.ue() + 1) * 16, bits.bits(1)
    height *= 2 - frames
    if not frames:
        bits.bits(1)
    bits.bits(1)
    if bits.bits(1):
        left, right, top, bottom = (bits.ue() for _ in range(4))
        x, y = (1 if chroma == 3 or separate or not chroma else 2), (2 if chroma == 1 else 1) * (2 - frames)
        width, height = width - (left + right) * x, height - (top + bottom) * y
    out: Fields = {"Format": "AVC", "Format_Profile": f"{AVC_PROFILES.get(profile, profile)}@L{level // 10}" + (f".{level % 10}" if level % 10 else ""), "Width": width, "Height": height, "ChromaSubsampling": CHROMA.get(chroma), "BitDepth": depth, "Format_Settings_RefFrames": references, "ScanType": "Progressive" if frames else None}
    try:
        out["FrameRate"] = _timing(bits) if bits.bits(1) else None
    except EOFError:
        pass
    return out


def hevc_parameters(nal: bytes) -> Fields:
    bits = Bits(unescaped(nal)[2:])
    bits.bits(4)
    layers = bits.bits(3)
    bits.bits(1)
    bits.bits(2)
    high, profile = bits.bits(1), bits.bits(5)
    bits.bits(32), bits.bits(48)
    level = bits.bits(8)
    flags = [(bits.bits(1), bits.bits(1)) for _ in range(layers)]
    if layers:
        bits.bits(2 * (8 - layers))
    for has_profile, has_level in flags:
        bits.bits(88 * has_profile + 8 * has_level)
    bits.ue()
    chroma = bits.ue()
    if chroma == 3:
        bits.bits(1)
    width, height = bits.ue(), bits.ue()
    if bits.bits(1):
        left, right, top, bottom = (bits.ue() for _ in range(4))
        width, height = width - (left + right) * (2 if chroma in (1, 2) else 1), height - (top + bottom) * (2 if chroma == 1 else 1)
    return {"Format": "HEVC", "Format_Profile": f"{HEVC_PROFILES.get(profile, profile)}@L{level / 30:g}@{'High' if high else 'Main'}", "Width": width, "Height": height, "ChromaSubsampling": CHROMA.get(chroma), "BitDepth": 8 + bits.ue()}


def avc(b: bytes) -> Streams | None:
    found = [u for u in units(b) if u and u[0] & 31 == 7 and not u[0] & 128]
    try:
        return [("Video", avc_parameters(found[0]))] if found else None
    except EOFError:
        return None


def hevc(b: bytes) -> Streams | None:
    found = [u for u in units(b) if u and u[0] >> 1 & 63 == 33]
    try:
        return [("Video", hevc_parameters(found[0]))] if found else None
    except EOFError:
        return None


def mpeg_video(b: bytes) -> Streams | None:
    own = units(b, stuffed=False)
    head = next((u for u in own if u[:1] == b"\xb3" and len(u) >= 8), None)
    if head is None:
        return None
    size, shape = int.from_bytes(head[1:4], "big"), head[4]
    second = next((u for u in own if u[:1] == b"\xb5" and len(u) >= 3 and u[1] >> 4 == 1), None)
    width, height, rate = size >> 12, size & 0xFFF, MPEG_RATES.get(shape & 15)
    ratio = {1: width / height if height else 0, 2: 4 / 3, 3: 16 / 9, 4: 2.21}.get(shape >> 4)
    out: Fields = {"Format": "MPEG Video", "Format_Version": "Version 2" if second else "Version 1", "Width": width, "Height": height, "FrameRate": rate, "DisplayAspectRatio": f"{ratio:.3f}" if second and ratio else None, "ChromaSubsampling": "4:2:0"}
    bits = int.from_bytes(head[5:8], "big") >> 6
    if bits != 0x3FFFF:
        out["BitRate_Maximum" if second else "BitRate"] = bits * 400
    if second:
        out |= {"ScanType": "Progressive" if second[2] & 8 else "Interlaced", "ChromaSubsampling": CHROMA.get(second[2] >> 1 & 3)}
    out["FrameCount"] = sum(u[:1] == b"\0" for u in own)
    return [("Video", out)]


def mpeg4_visual(b: bytes) -> Streams | None:
    own = units(b)
    if not any(u and 0x20 <= u[0] <= 0x2F for u in own):
        return None
    level = next((u[1] for u in own if u[:1] == b"\xb0" and len(u) > 1), None)
    return [("Video", {"Format": "MPEG-4 Visual", "Format_Profile": None if level is None else "Simple" if level < 16 else "Advanced Simple" if level >= 0xF0 else str(level)})]


def packet_size(b: bytes) -> tuple[int, int] | None:
    """Size of a transport stream's packets and the place of their sync bytes."""
    for size, first in ((188, 0), (192, 4), (204, 0)):
        repeats = sum(b[first + k * size : first + k * size + 1] == b"\x47" for k in range(8))
        if repeats >= min(8, max(3, (len(b) - first) // size)):
            return size, first
    return None


def transport(b: bytes) -> Streams | None:
    shape = packet_size(b)
    if not shape:
        return None
    size, first = shape
    maps: dict[int, int] = {}
    out: dict[int, tuple[str, Fields]] = {}
    clocks: list[int] = []
    programs = 0
    for at in range(first, len(b) - 187, size):
        pid, flags = int.from_bytes(b[at + 1 : at + 3], "big") & 0x1FFF, b[at + 3]
        body = at + 4
        if flags & 0x20:
            if b[body] >= 7 and b[body + 1] & 0x10:
                clocks.append(int.from_bytes(b[body + 2 : body + 6], "big") << 1 | b[body + 6] >> 7)
            body += 1 + b[body]
        if not (flags & 0x10 and b[at + 1] & 0x40 and body < at + 188):
            continue
        section = b[body + 1 + b[body] : at + 188]
        length = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF) - 4
        if pid == 0 and section[:1] == b"\0":
            maps |= {int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF: int.from_bytes(section[k : k + 2], "big") for k in range(8, min(length, len(section) - 3), 4) if section[k : k + 2] != b"\0\0"}
        elif pid in maps and section[:1] == b"\2":
            k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            programs = len(maps)
            while k + 5 <= min(length, len(section)):
                own = int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF
                kind, format_ = STREAM_TYPES.get(section[k], ("Other", ""))
                out.setdefault(own, (kind, {"ID": own, "Format": format_, "CodecID": section[k], "MenuID": maps[pid]}))
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    if not out:
        return None
    span = (clocks[-1] - clocks[0]) % (1 << 33) if len(clocks) > 1 else 0
    menus: Streams = [("Menu", {"ID": n, "Format": " / ".join(str(f["Format"]) for _, f in out.values() if f["MenuID"] == n)}) for n in sorted(set(maps.values()))]
    return [("General", {"Format": "BDAV" if size == 192 else "MPEG-TS", "Duration": round(span / 90) or None, "Program_Count": programs}), *sorted(out.values(), key=lambda s: (["Video", "Audio", "Text", "Other"].index(s[0]), s[1]["ID"])), *menus]


def program(b: bytes) -> Streams | None:
    if b[:4] != b"\0\0\1\xba":
        return None
    seen: dict[int, tuple[str, Fields]] = {}
    stamps: dict[int, list[int]] = {}
    for found in re.finditer(rb"\x00\x00\x01([\xbd\xc0-\xef])", b):
        own, at = found[1][0], found.end()
        kind, format_ = ("Video", "MPEG Video") if own >= 0xE0 else ("Audio", "MPEG Audio") if own >= 0xC0 else ("Audio", "AC-3")
        seen.setdefault(own, (kind, {"ID": own, "Format": format_}))
        if len(b) >= at + 10 and b[at + 2] >> 6 == 2 and b[at + 3] & 0x80:
            p = b[at + 5 : at + 10]
            stamps.setdefault(own, []).append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
    for own, (_, fields) in seen.items():
        if own in stamps:
            fields |= {"Delay": round(stamps[own][0] / 90), "Duration": round((stamps[own][-1] - stamps[own][0]) % (1 << 33) / 90) or None}
    return [seen[k] for k in sorted(seen, key=lambda k: (seen[k][0] != "Video", k))] or None


def asf(b: bytes) -> Streams | None:
    if b[:16] != ASF_HEADER or len(b) < 30:
        return None
    general: Fields = {"Format": "Windows Media"}
    out: Streams = []
    at, end = 30, min(int.from_bytes(b[16:24], "little"), len(b))
    while at + 24 <= end:
        guid, size = b[at : at + 16], int.from_bytes(b[at + 16 : at + 24], "little")
        body = b[at + 24 : at + size]
        if guid == ASF_FILE and len(body) >= 80:
            play, early = int.from_bytes(body[40:48], "little") // 10_000, int.from_bytes(body[56:64], "little")
            general |= {"Duration": max(play - early, 0) or None, "OverallBitRate_Maximum": int.from_bytes(body[76:80], "little") or None}
        elif guid == ASF_CONTENT and len(body) >= 10:
            sizes, k = struct.unpack("<5H", body[:10]), 10
            for name, n in zip(("Title", "Performer", "Copyright", "Comment", "LawRating"), sizes, strict=True):
                general[name] = clean(utf16(body[k : k + n], "little")) or None
                k += n
        elif guid == ASF_STREAM and len(body) >= 54:
            own = body[54:]
            number = int.from_bytes(body[48:50], "little") & 127
            if body[:16] == ASF_AUDIO and len(own) >= 16:
                tag, channels, rate, per_second, _, depth = struct.unpack("<HHIIHH", own[:16])
                out.append(("Audio", {"ID": number, "Format": "WMA" if 0x160 <= tag <= 0x163 else f"{tag:X}", "CodecID": f"{tag:X}", "Channel(s)": channels, "SamplingRate": rate, "BitRate": per_second * 8, "BitDepth": depth or None}))
            elif body[:16] == ASF_VIDEO and len(own) >= 31:
                code = own[27:31].decode("latin-1")
                out.append(("Video", {"ID": number, "Format": {"WVC1": "VC-1"}.get(code, code), "CodecID": code, "Width": int.from_bytes(own[:4], "little"), "Height": int.from_bytes(own[4:8], "little")}))
        if size < 24:
            break
        at += size
    return [("General", general), *out]


def real(b: bytes) -> Streams | None:
    if b[:4] != b".RMF":
        return None
    general: Fields = {"Format": "RealMedia"}
    out: Streams = []
    at = int.from_bytes(b[4:8], "big")
    while at + 10 <= len(b):
        name, size = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], "big")
        body = b[at + 10 : at + size]
        if name == b"PROP" and len(body) >= 24:
            general |= {"OverallBitRate_Maximum": int.from_bytes(body[0:4], "big"), "OverallBitRate": int.from_bytes(body[4:8], "big"), "Duration": int.from_bytes(body[20:24], "big")}
        elif name == b"CONT":
            k = 0
            for field in ("Title", "Performer", "Copyright", "Comment"):
                n = int.from_bytes(body[k : k + 2], "big")
                general[field] = clean(body[k + 2 : k + 2 + n].decode("latin-1")) or None
                k += 2 + n
        elif name == b"MDPR" and len(body) >= 31:
            k = 30 + 1 + body[30]
            mime = body[k + 1 : k + 1 + body[k]].decode("latin-1") if k < len(body) else ""
            kind = "Video" if "video" in mime else "Audio" if "audio" in mime else None
            if kind:
                out.append((kind, {"ID": int.from_bytes(body[0:2], "big"), "BitRate": int.from_bytes(body[6:10], "big"), "Duration": int.from_bytes(body[26:30], "big")}))
        if size < 10 or name == b"DATA":
            break
        at += size
    return [("General", general), *out]


def mxf(b: bytes) -> Streams | None:
    at = b[: 64 * 1024].find(MXF_KEY)
    return [("General", {"Format": "MXF", "Format_Settings": {2: "Open / Incomplete", 1: "Open / Incomplete", 3: "Open / Complete", 4: "Closed / Complete"}.get(b[at + 14])})] if at >= 0 and len(b) > at + 14 else None


def nut(b: bytes) -> Streams | None:
    return [("General", {"Format": "Nut"})] if b.startswith(NUT_HEAD) else None


def dv(b: bytes) -> Streams | None:
    if len(b) < 480 or b[0] != 0x1F or b[1] & 0xF0 != 0x07 & 0xF0 or b[80] >> 5 != 1:
        return None
    pal = bool(b[3] & 0x80)
    frame = 144_000 if pal else 120_000
    return [("Video", {"Format": "DV", "Width": 720, "Height": 576 if pal else 480, "FrameRate": "25.000" if pal else "29.970", "Standard": "PAL" if pal else "NTSC", "FrameCount": len(b) // frame or None, "ChromaSubsampling": "4:2:0" if pal else "4:1:1"})]


def wavpack(b: bytes) -> Streams | None:
    if b[:4] != b"wvpk" or len(b) < 32:
        return None
    version, samples, flags = int.from_bytes(b[8:10], "little"), int.from_bytes(b[12:16], "little"), int.from_bytes(b[24:28], "little")
    code = flags >> 23 & 15
    rate = WAVPACK_RATES[code] if code < 15 else None
    return [("Audio", {"Format": "WavPack", "Format_Version": f"Version {version >> 8}.{version & 255}", "Channel(s)": 1 if flags & 4 else 2, "BitDepth": 8 * ((flags & 3) + 1), "SamplingRate": rate, "Duration": round(samples * 1000 / rate) if rate and samples != 0xFFFFFFFF else None, "Compression_Mode": "Lossy" if flags & 8 else "Lossless"})]


def ape(b: bytes) -> Streams | None:
    if b[:4] != b"MAC " or len(b) < 76:
        return None
    version = int.from_bytes(b[4:6], "little")
    if version < 3980:
        return None
    at = int.from_bytes(b[8:12], "little")
    per, last, total, depth, channels, rate = struct.unpack("<IIIHHI", b[at + 4 : at + 24])
    samples = (total - 1) * per + last if total else 0
    return [("Audio", {"Format": "Monkey's Audio", "Format_Version": f"Version {version / 1000:.3f}", "Channel(s)": channels, "SamplingRate": rate, "BitDepth": depth, "Duration": round(samples * 1000 / rate) if rate else None, "Compression_Mode": "Lossless"})]


def dts(b: bytes) -> Streams | None:
    at, frames, out = 0, 0, None
    while b[at : at + 4] == b"\x7f\xfe\x80\x01" and at + 12 <= len(b):
        bits = Bits(b[at + 4 : at + 12])
        bits.bits(7)
        blocks, size, channels, rate = bits.bits(7) + 1, bits.bits(14) + 1, bits.bits(6), bits.bits(4)
        rate = DTS_RATES[rate] if rate < len(DTS_RATES) else 0
        if not rate or size < 96:
            break
        out, frames, at = (blocks * 32, channels, rate), frames + 1, at + size
    if not out or frames < 2:
        return None
    return [("Audio", {"Format": "DTS", "Channel(s)": DTS_CHANNELS[out[1]] if out[1] < 16 else None, "SamplingRate": out[2], "SamplesPerFrame": out[0], "FrameCount": frames, "Duration": round(frames * out[0] * 1000 / out[2])})]


def jpeg2000(b: bytes) -> Streams | None:
    at = b.find(b"\xff\x4f\xff\x51")
    if at < 0 or len(b) < at + 42:
        return None
    _, right, bottom, left, top = struct.unpack(">HIIII", b[at + 6 : at + 24])
    parts = int.from_bytes(b[at + 40 : at + 42], "big")
    return [("Image", {"Format": "JPEG 2000", "Width": right - left, "Height": bottom - top, "BitDepth": (b[at + 42] & 127) + 1 if len(b) > at + 42 else None, "ColorSpace": "YUV" if parts == 3 else "Y" if parts == 1 else None})]


def mlp(b: bytes) -> Streams | None:
    sync = b[4:8]
    if sync not in (b"\xf8\x72\x6f\xba", b"\xf8\x72\x6f\xbb"):
        return None
    code = b[8] >> 4
    rate = (48000 if code < 8 else 44100) << (code & 7) if code & 7 < 3 else None
    return [("Audio", {"Format": "MLP FBA" if sync[3] == 0xBA else "MLP", "SamplingRate": rate, "Compression_Mode": "Lossless"})]


def latm(b: bytes) -> Streams | None:
    at = frames = 0
    while at + 3 <= len(b) and int.from_bytes(b[at : at + 2], "big") >> 5 == 0x2B7:
        at, frames = at + 3 + (int.from_bytes(b[at + 1 : at + 3], "big") & 0x1FFF), frames + 1
    return [("Audio", {"Format": "AAC", "MuxingMode": "LATM", "FrameCount": frames})] if frames >= 3 else None


def vc3(b: bytes) -> Streams | None:
    if b[:4] != b"\0\0\2\x80" or len(b) < 46:
        return None
    return [("Video", {"Format": "VC-3", "Height": int.from_bytes(b[24:26], "big"), "Width": int.from_bytes(b[26:28], "big"), "BitDepth": {1: 8, 2: 10, 3: 12}.get(b[33] >> 5)})]
