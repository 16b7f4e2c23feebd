"""Tags of containers: Vorbis comments, ID3, APEv2, RIFF INFO and MP4 item lists, as fields of the General stream."""

from __future__ import annotations

import re

from reelframe.sources.bits import clean, latin1, utf16

Fields = dict[str, object]
#: Field of each Vorbis comment.
VORBIS = {
    "TITLE": "Title", "ARTIST": "Performer", "ALBUM": "Album", "ALBUMARTIST": "Album/Performer", "ALBUM ARTIST": "Album/Performer", "ALBUM_ARTIST": "Album/Performer", "DATE": "Recorded_Date", "YEAR": "Recorded_Date", "TRACKNUMBER": "Track/Position",
    "TRACKTOTAL": "Track/Position_Total", "TOTALTRACKS": "Track/Position_Total", "DISCNUMBER": "Part/Position", "DISCTOTAL": "Part/Position_Total", "TOTALDISCS": "Part/Position_Total", "GENRE": "Genre", "COMMENT": "Comment", "COMMENTS": "Comment", "DESCRIPTION": "Comment",
    "COMPOSER": "Composer", "CONDUCTOR": "Conductor", "LYRICIST": "Lyricist", "COPYRIGHT": "Copyright", "ORGANIZATION": "Publisher", "PUBLISHER": "Publisher", "LABEL": "Publisher", "ISRC": "ISRC", "LYRICS": "Lyrics", "UNSYNCEDLYRICS": "Lyrics", "LANGUAGE": "Language",
    "REPLAYGAIN_TRACK_GAIN": "ReplayGain_Gain", "REPLAYGAIN_TRACK_PEAK": "ReplayGain_Peak", "REPLAYGAIN_ALBUM_GAIN": "Album_ReplayGain_Gain", "REPLAYGAIN_ALBUM_PEAK": "Album_ReplayGain_Peak", "ENCODED_BY": "EncodedBy", "ENCODER_OPTIONS": "Encoded_Library_Settings", "ENCODER_SETTINGS": "Encoded_Library_Settings", "ENCODER": "Encoded_Application",
}
#: Field of each ID3v2 text frame.
ID3 = {
    "TIT2": "Title", "TPE1": "Performer", "TALB": "Album", "TYER": "Recorded_Date", "TDRC": "Recorded_Date", "TDRL": "Released_Date", "TDEN": "Encoded_Date", "TDTG": "Tagged_Date", "TORY": "Original/Released_Date", "TDOR": "Original/Released_Date", "TCOM": "Composer", "TPE2": "Album/Performer",
    "TPE3": "Conductor", "TPE4": "RemixedBy", "TPUB": "Publisher", "TCOP": "Copyright", "TENC": "EncodedBy", "TBPM": "BPM", "TSRC": "ISRC", "TLAN": "Language", "TIT1": "Grouping", "TIT3": "Track_More", "TOAL": "Original/Album", "TOPE": "Original/Performer", "TEXT": "Lyricist",
    "TOLY": "Original/Lyricist", "TMOO": "Mood", "TSOT": "Track/Sort", "TSOP": "Performer/Sort", "TSOA": "Album/Sort", "TOWN": "Owner", "TRSN": "ServiceName", "TRSO": "ServiceProvider", "TMED": "OriginalSourceMedium", "TSSE": "Encoded_Library",
}
#: ID3v2.2 names of frames.
ID3_SHORT = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TP3": "TPE3", "TP4": "TPE4", "TAL": "TALB", "TRK": "TRCK", "TPA": "TPOS", "TYE": "TYER", "TCO": "TCON", "TCM": "TCOM", "TPB": "TPUB", "TCR": "TCOP", "TEN": "TENC", "TBP": "TBPM", "TRC": "TSRC", "TLA": "TLAN", "TT1": "TIT1", "TT3": "TIT3", "TSS": "TSSE", "COM": "COMM", "ULT": "USLT", "TXX": "TXXX"}
#: Genres by number, the first eighty of ID3v1.
GENRES = "Blues,Classic Rock,Country,Dance,Disco,Funk,Grunge,Hip-Hop,Jazz,Metal,New Age,Oldies,Other,Pop,R&B,Rap,Reggae,Rock,Techno,Industrial,Alternative,Ska,Death Metal,Pranks,Soundtrack,Euro-Techno,Ambient,Trip-Hop,Vocal,Jazz+Funk,Fusion,Trance,Classical,Instrumental,Acid,House,Game,Sound Clip,Gospel,Noise,Alternative Rock,Bass,Soul,Punk,Space,Meditative,Instrumental Pop,Instrumental Rock,Ethnic,Gothic,Darkwave,Techno-Industrial,Electronic,Pop-Folk,Eurodance,Dream,Southern Rock,Comedy,Cult,Gangsta,Top 40,Christian Rap,Pop/Funk,Jungle,Native US,Cabaret,New Wave,Psychadelic,Rave,Showtunes,Trailer,Lo-Fi,Tribal,Acid Punk,Acid Jazz,Polka,Retro,Musical,Rock & Roll,Hard Rock".split(",")
#: Field of each RIFF INFO chunk.
INFO = {
    "INAM": "Title", "IART": "Performer", "ICMT": "Comment", "ICRD": "Recorded_Date", "IGNR": "Genre", "ICOP": "Copyright", "IPRD": "Album", "ISFT": "Encoded_Application", "ITRK": "Track/Position", "IPRT": "Track/Position", "ISBJ": "Subject", "IKEY": "Keywords", "IENG": "Engineer", "ITCH": "EncodedBy", "IWRI": "WrittenBy",
    "IPRO": "Producer", "IEDT": "EditedBy", "IDIT": "Encoded_Date", "IMED": "OriginalSourceMedium", "ILNG": "Language", "ICMS": "Commissioned", "ISRC": "Source", "ICNM": "Director", "IMUS": "Composer", "ILYR": "Lyrics", "IPUB": "Publisher", "IRTD": "LawRating", "ISTR": "Actor", "ISTA": "Actor",
}
#: Field of each MP4 item.
ITEMS = {
    "©nam": "Title", "©ART": "Performer", "aART": "Album/Performer", "©alb": "Album", "©day": "Recorded_Date", "©cmt": "Comment", "©gen": "Genre", "gnre": "Genre", "©too": "Encoded_Application", "©swr": "Encoded_Application", "©enc": "EncodedBy", "©wrt": "Composer", "©cpy": "Copyright", "cprt": "Copyright", "©lyr": "Lyrics", "©grp": "Grouping",
    "©des": "Description", "desc": "Description", "©inf": "Description", "ldes": "Description", "©prd": "Producer", "©dir": "Director", "trkn": "Track/Position", "disk": "Part/Position", "tmpo": "BPM", "cpil": "Compilation", "covr": "Cover", "tvsh": "Collection", "tvsn": "Season", "tves": "Part", "tven": "Season_Position", "purd": "Added_Date",
    "sonm": "Title/Sort", "soar": "Performer/Sort", "soal": "Album/Sort", "soco": "Composer/Sort", "keyw": "Keywords", "catg": "PodcastCategory", "rtng": "LawRating", "©mak": "Encoded_Application_CompanyName", "©mod": "Encoded_Hardware", "©xyz": "Recorded_Location",
}


def genre_name(given: str) -> str:
    """`(17)`, `17` and `(17)Rock` by number; other text as it stands."""
    found = re.fullmatch(r"\((\d+)\)(.*)|(\d+)", given.strip())
    if not found:
        return given
    if found[2]:
        return found[2]
    number = int(found[1] or found[3])
    return GENRES[number] if number < len(GENRES) else given


def put_position(out: Fields, field: str, given: str) -> None:
    """`3/12` as a position and a total."""
    place, _, total = given.partition("/")
    out[f"{field}/Position"] = place.strip()
    if total.strip():
        out[f"{field}/Position_Total"] = total.strip()


def vorbis(data: bytes) -> Fields:
    """A comment block: the vendor, then name=value items; of a name the first value stays."""
    out: Fields = {}
    size = int.from_bytes(data[:4], "little")
    vendor = clean(data[4 : 4 + size].decode("utf-8", "replace"))
    at, count = 8 + size, int.from_bytes(data[4 + size : 8 + size], "little")
    for _ in range(count):
        n = int.from_bytes(data[at : at + 4], "little")
        name, sign, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        at += 4 + n
        name, value = name.strip().upper(), clean(value)
        if sign and value and name != "METADATA_BLOCK_PICTURE":
            field = VORBIS.get(name, name)
            out.setdefault(field, value.removesuffix("dB").strip() if field.endswith("_Gain") else value)
            if field == "Title":
                out.setdefault("Track", value)
        if at >= len(data):
            break
    return out | ({"Encoded_Library": vendor} if vendor else {})


def id3_text(data: bytes) -> str:
    """Text of a frame by its first byte's encoding; several values are joined."""
    kind, body = data[:1], data[1:]
    text = utf16(body, "little") if kind == b"\1" else utf16(body) if kind == b"\2" else body.decode("utf-8" if kind == b"\3" else "latin-1", "replace")
    return " / ".join(x for x in (clean(p) for p in text.split("\0")) if x)


def _split(data: bytes) -> tuple[bytes, bytes]:
    """A frame's short text with its encoding, and the text behind it with the same."""
    kind, body = data[:1], data[1:]
    if kind in (b"\1", b"\2"):
        end = next((k for k in range(0, len(body) - 1, 2) if body[k : k + 2] == b"\0\0"), len(body))
        return kind + body[:end], kind + body[end + 2 :]
    head, _, rest = body.partition(b"\0")
    return kind + head, kind + rest


def _syncsafe(b: bytes) -> int:
    return sum((x & 127) << 7 * k for k, x in enumerate(reversed(b)))


def id3v2(data: bytes) -> tuple[Fields, int]:
    """Fields of a tag at the beginning of data, and its length (0 without one)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    version, size = data[3], 10 + _syncsafe(data[6:10])
    out: Fields = {}
    short, at = version == 2, 10
    while at + (6 if short else 10) <= min(size, len(data)) and data[at]:
        if short:
            name, n, head = ID3_SHORT.get(data[at : at + 3].decode("latin-1"), ""), int.from_bytes(data[at + 3 : at + 6], "big"), 6
        else:
            name, head = data[at : at + 4].decode("latin-1"), 10
            n = _syncsafe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + head : at + head + n]
        at += head + n
        if not body:
            continue
        if name in ("COMM", "USLT"):
            if text := id3_text(_split(body[:1] + body[4:])[1]):
                out["Comment" if name == "COMM" else "Lyrics"] = text
        elif name == "TXXX":
            key, value = map(id3_text, _split(body))
            if key and value:
                out[key] = value
        elif name == "APIC":
            out["Cover"] = "Yes"
            out["Cover_Mime"] = latin1(body[1:])
        elif name in ("TRCK", "TPOS"):
            put_position(out, "Track" if name == "TRCK" else "Part", id3_text(body))
        elif name == "TCON":
            out["Genre"] = genre_name(id3_text(body))
        elif name == "TCMP":
            out |= {"Compilation": "Yes"} if id3_text(body) == "1" else {}
        elif name in ID3 and (text := id3_text(body)):
            field = ID3[name]
            if field != "Recorded_Date" or field not in out:
                out[field] = text
            if field == "Title":
                out["Track"] = text
    return out, size


def id3v1(data: bytes) -> Fields:
    """Fields of the 128 bytes at the end of a file."""
    tail = data[-128:]
    if tail[:3] != b"TAG" or len(tail) < 128:
        return {}
    text = lambda i, j: clean(latin1(tail[i:j]))
    out: Fields = {"Title": text(3, 33), "Track": text(3, 33), "Performer": text(33, 63), "Album": text(63, 93), "Recorded_Date": text(93, 97), "Comment": text(97, 127)}
    if tail[125] == 0 and tail[126]:
        out |= {"Comment": text(97, 125), "Track/Position": tail[126]}
    if tail[127] < len(GENRES):
        out["Genre"] = GENRES[tail[127]]
    return {k: v for k, v in out.items() if v not in ("", None)}


def apev2(data: bytes) -> Fields:
    """Fields of a tag whose footer ends the data (before an ID3v1 tag, if there is one)."""
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    footer = data[end - 32 : end]
    if footer[:8] != b"APETAGEX":
        return {}
    size, count = int.from_bytes(footer[12:16], "little"), int.from_bytes(footer[16:20], "little")
    out: Fields = {}
    at = end - size
    for _ in range(count):
        n, flags = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        stop = data.find(b"\0", at + 8, end)
        if at < 0 or stop < 0:
            break
        key, value = data[at + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n]
        at = stop + 1 + n
        if flags & 6:
            continue
        text = " / ".join(x for x in (clean(p) for p in value.decode("utf-8", "replace").split("\0")) if x)
        if key.upper() in ("TRACK", "DISC"):
            put_position(out, "Track" if key.upper() == "TRACK" else "Part", text)
        elif text:
            out.setdefault(VORBIS.get(key.upper(), key), text)
    return out


def riff_info(chunks: list[tuple[bytes, bytes]]) -> Fields:
    """Fields of INFO chunks; the first value of a field stays."""
    out: Fields = {}
    for name, value in chunks:
        field, text = INFO.get(name.decode("latin-1")), clean(latin1(value))
        if field and text:
            out.setdefault(field, text)
    return out


def mp4_items(items: list[tuple[str, int, bytes]]) -> Fields:
    """Fields of items (name, or ----:mean:name; type of the value; value); the last value of a field stays."""
    out: Fields = {}
    for name, kind, value in items:
        if name in ("trkn", "disk") and len(value) >= 6:
            place, total = int.from_bytes(value[2:4], "big"), int.from_bytes(value[4:6], "big")
            put_position(out, "Track" if name == "trkn" else "Part", f"{place}/{total}" if total else str(place))
            continue
        text = str(int.from_bytes(value, "big")) if kind in (0, 21) and name in ("tmpo", "cpil", "rtng", "tvsn", "tves", "gnre") else utf16(value) if kind == 2 else clean(value.decode("utf-8", "replace"))
        if name == "gnre":
            text = genre_name(str(int(text) - 1))
        field = ITEMS.get(name) or (name.rsplit(":", 1)[-1] if name.startswith("----:") else None)
        if not field:
            continue
        out[field] = "Yes" if field == "Cover" else ("Yes" if text == "1" else "No") if field == "Compilation" else text
        if field == "Title":
            out["Movie"] = text
    return {k: v for k, v in out.items() if v}
