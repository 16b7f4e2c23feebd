"""The derivation pass: fields of a stream that follow from its other fields, and of a file from its streams.

Streams are rows of file, kind, idx and fields (map of name to text), as the media source gives them. A phase is one
projection over the map: its entries fill empty fields only, unless said otherwise. Rules that read what others fill come in a later
phase, which `phased` sees to. All is built from Catalyst functions; only numbers of over 64 bits go through Arrow. What a
file's streams add up to is one aggregate by file, joined back to the file's General row.

The same rules also hold for streams with a column per field (`COLUMN` and the field's name): `value_columns` and
`name_columns` fill the fields that are named to them, so that a plan computes those and what they need, and builds no maps.

Fields are text: a value that isn't a number counts as missing where a number is wanted, a division by nothing fills
nothing, null maps are empty ones. Decimals round the exact binary value, ties to even.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reelframe.functions import formatters as f
from reelframe.functions import tables
from reelframe.functions.text import channel_positions
from reelframe.operators.elements import let
from reelframe.operators.streams import KINDS, known_total, overall_mode
from reelframe.sources.tables import checkpointed

Entries = list[tuple[str, Column]]
#: Words of coded values, by field.
WORDS = {
    "BitRate_Mode": {"CBR": "Constant", "VBR": "Variable"}, "OverallBitRate_Mode": {"CBR": "Constant", "VBR": "Variable"}, "FrameRate_Mode": {"CFR": "Constant", "VFR": "Variable"}, "Delay_Source": {"Stream": "Raw stream"},
    "Alignment": {"Aligned": "Aligned on interleaves", "Split": "Split across interleaves"}, "ScanOrder": {"TFF": "Top Field First", "BFF": "Bottom Field First"}, "ScanOrder_Original": {"TFF": "Top Field First", "BFF": "Bottom Field First"},
    "Interlacement": {"PPF": "Progressive", "TFF": "Top Field First", "BFF": "Bottom Field First"},
}
#: Fields whose /String is their own text.
SAME = "Default Forced Disabled AlternateGroup ServiceKind Compression_Mode ScanType ScanType_Original ScanType_StoreMethod Compilation Format_Settings_CABAC Format_Settings_BVOP Format_Settings_QPel Format_Settings_Matrix Format_Settings_SBR Format_Settings_PS Gop_OpenClosed Gop_OpenClosed_FirstFrame ActiveFormatDescription ChromaSubsampling Resolution OriginalSourceMedium_ID MenuID HDR_Format Codec".split()
#: Bases of duration, delay, bit rate, size, frame rate, pixel and bit strings.
DURATIONS = "Duration Duration_FirstFrame Duration_LastFrame Source_Duration Source_Duration_FirstFrame Source_Duration_LastFrame".split()
DELAYS = "Delay Delay_Original Video_Delay Video0_Delay TimeStamp_FirstFrame".split()
BIT_RATES = "BitRate BitRate_Minimum BitRate_Nominal BitRate_Maximum BitRate_Encoded OverallBitRate OverallBitRate_Minimum OverallBitRate_Nominal OverallBitRate_Maximum".split()
SIZES = "StreamSize Source_StreamSize StreamSize_Encoded Source_StreamSize_Encoded".split()
FRAME_RATES = "FrameRate FrameRate_Minimum FrameRate_Nominal FrameRate_Maximum FrameRate_Original".split()
PIXELS = "Width Height Width_Original Height_Original Width_CleanAperture Height_CleanAperture Width_Offset Height_Offset".split()
BITS = "BitDepth BitDepth_Detected BitDepth_Stored".split()
CHANNELS = "Channel(s) Channel(s)_Original Matrix_Channel(s)".split()
#: Formats that are sampled at their own size.
SAMPLED = ["AVC", "HEVC", "MPEG Video", "MPEG-4 Visual", "AV1", "H.263", "JPEG"]


def text(name: str) -> Column:
    """A field's text; null where it is missing or empty."""
    return F.nullif(F.element_at("fields", F.lit(name)), F.lit(""))


def number(name: str) -> Column:
    return F.expr(f"try_cast(element_at(fields, '{name}') AS DOUBLE)")


#: What the name of a field's own column begins with.
COLUMN = ":"


class Look:
    """Where rules read fields: in the map `fields`, or in a column per field."""

    def __init__(self, streams: DataFrame, columns: bool = False, rate_text: Callable[[Column], Column] | None = None):
        self.rate_text = rate_text or bit_rate_text
        self.columns = set(streams.columns) if columns else None
        self.total = F.col("file_size").cast("double") if "file_size" in streams.columns else F.lit(None).cast("double")

    def text(self, name: str) -> Column:
        if self.columns is None:
            return text(name)
        return F.nullif(F.col(f"`{COLUMN}{name}`"), F.lit("")) if COLUMN + name in self.columns else F.lit(None).cast("string")

    def number(self, name: str) -> Column:
        return number(name) if self.columns is None else self.text(name).try_cast("double")


def filled(streams: DataFrame, entries: Entries | Column, over: bool = False) -> DataFrame:
    """The streams with the entries (pairs, or an array of key and value) that have text; a field that has text stays, unless over."""
    given = entries if isinstance(entries, Column) else F.array(*(F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in entries))
    told = F.filter(given, lambda x: F.coalesce(x["value"], F.lit("")) != "")
    held = F.map_filter("fields", lambda _, v: F.coalesce(v, F.lit("")) != "")
    if over:
        new = streams.withColumn("__new", F.map_from_entries(told))
        return new.withColumn("fields", F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key("__new", k)), F.col("__new"))).drop("__new")
    added = F.filter(told, lambda x: ~F.map_contains_key("fields", x["key"]))
    return streams.withColumn("fields", held).withColumn("fields", F.map_concat("fields", F.map_from_entries(added)))


def filled_columns(streams: DataFrame, entries: Entries, over: bool = False) -> DataFrame:
    """`filled` for streams with a column per field."""
    look = Look(streams, columns=True)
    given = {n: v.cast("string") for n, v in entries}  # an empty text is read as none, so it needs no test here
    return streams.withColumns({COLUMN + n: F.coalesce(F.nullif(v, F.lit("")), look.text(n)) if over else F.coalesce(look.text(n), v) for n, v in given.items()})


def decimals(value: Column, digits: int, grouped: bool = True) -> Column:
    """So many decimals (to six) of a double, its exact binary value rounded half to even; thousands apart, or not.

    format_number rounds exactly but beside ties and from 2**53 on (of the product with the power of ten); there `_beside_ties` does it.
    Doubles from 2**53 on are integers, and format_number shows those exactly.
    """
    product = F.abs(value) * 10.0**digits
    shown = lambda n: F.translate(F.format_number(n, digits), ",", " " if grouped else "")
    large = F.when(F.abs(value) >= 2.0**53, shown(value.try_cast("decimal(38,0)"))).otherwise(_beside_ties(value, digits, grouped))
    return F.when((product % 1.0 == 0.5) | (product >= 2.0**53), large).otherwise(shown(value + 0.0))


def _beside_ties(value: Column, digits: int, grouped: bool) -> Column:
    """`decimals` of a value whose product with a power of ten looks like a tie, or is 2**53 or more.

    The product is taken with its rounding error, so ties are told from values beside them; exact for products below 2**53, and larger
    ones have no binary digits behind the point that would count.
    """
    scale = F.lit(10.0**digits)
    halves = lambda x: F.struct((x * 134217729.0 - (x * 134217729.0 - x)).alias("h"), (x - (x * 134217729.0 - (x * 134217729.0 - x))).alias("l"))

    def rounded(x: Column) -> Column:
        error = ((x["v"]["h"] * x["s"]["h"] - x["p"]) + x["v"]["h"] * x["s"]["l"] + x["v"]["l"] * x["s"]["h"]) + x["v"]["l"] * x["s"]["l"]
        low = F.floor(x["p"])
        beyond = (x["p"] - low.cast("double") - 0.5) + error
        return low + F.when((beyond > 0) | ((beyond == 0) & (low % 2 == 1)), 1).otherwise(0)

    def shown(n: Column) -> Column:
        unit = scale.cast("long")
        number_ = F.format_number(F.floor(n / unit), 0) if grouped else F.floor(n / unit).cast("string")
        behind = F.when(scale > 1, F.concat(F.lit("."), F.lpad((n % unit).cast("string"), F.length(unit.cast("string")) - 1, F.lit("0")))).otherwise("")
        return F.concat(F.translate(number_, ",", " "), behind)

    def signed(v: Column) -> Column:
        text_ = let(F.struct(halves(F.abs(v)).alias("v"), halves(scale).alias("s"), (F.abs(v) * scale).alias("p")), lambda x: let(rounded(x).cast("long"), shown))
        return F.concat(F.when(v < 0, "-").otherwise(""), text_)

    return let(value, signed)


def plain(value: Column, digits: int) -> Column:
    return decimals(value, digits, grouped=False)


def whole(value: Column) -> Column:
    """A double as an integer's text, rounded half up."""
    return F.floor(value + 0.5).cast("long").cast("string")


def significant(value: Column, digits: int, settled: bool = True) -> Column:
    """So many significant digits, the whole part always kept; rounding may add a digit to it.

    settled: the rounded number decides how many decimals there are and whether thousands stand apart, else the number before.
    """

    def bound(power: int) -> float:
        """The least double that has a further digit before its point, once it is rounded (ties at nines round up)."""
        exact = Fraction(10**power) - (Fraction(1, 2 * 10 ** max(digits - power, 0)) if settled else 0)
        return float(exact) if Fraction(float(exact)) >= exact else math.nextafter(float(exact), math.inf)

    size = F.abs(value)
    least = F.when(size < bound(3), decimals(value, 0, False)).otherwise(decimals(value, 0))
    return reduce(lambda out, k: F.when(size < bound(k), decimals(value, digits - k, False)).otherwise(out), range(digits - 1, 0, -1), least)


def size_texts(n: Column) -> Column:
    """Bytes in binary units with three digits, as a whole number, and with 2, 3 and 4 digits; a power of two divides doubles exactly."""
    power = lambda v: reduce(lambda out, k: out.when(v < 1024 ** (k + 1), k), range(1, 5), F.when(v < 1024, 0)).otherwise(5)
    by, units = F.array(*(F.lit(1024.0**k) for k in range(6))), F.array(*map(F.lit, f.SIZE_UNITS))
    parts = lambda v, k: F.struct(k.alias("k"), (v.cast("double") / F.get(by, k)).alias("x"), F.concat(F.lit(" "), F.get(units, k), F.when((k == 0) & (v > 1), "s").otherwise("")).alias("unit"))

    def shown(s: Column) -> Column:
        digits = F.array(*(F.when(s["k"] == 0, decimals(s["x"], 0, False)).otherwise(significant(s["x"], d)) for d in (2, 3, 4)))
        return let(digits, lambda t: F.transform(F.array(F.get(t, F.lit(1)), decimals(s["x"], 0, False), F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.get(t, F.lit(2))), lambda x: F.concat(x, s["unit"])))

    return let(n.cast("long"), lambda v: let(let(power(v), lambda k: parts(v, k)), shown))


def bit_rate_text(given: Column, settled: bool = True, units: int = 3) -> Column:
    """One bit rate, or a list with ` / ` between, each with its unit and three significant digits; parts that are no numbers go.

    units: how many of kb/s, Mb/s and Gb/s there are above b/s; settled: see `significant`.
    """
    steps = [(10_000_000 * 1000**k, 1000.0 ** (k + 1), f" {unit}/s") for k, unit in enumerate(("kb", "Mb", "Gb")[:units])]

    def one(v: Column) -> Column:
        texts = [(end, F.concat(significant(v / by, 3, settled), F.lit(unit))) for end, by, unit in steps]
        small = F.concat(F.translate(F.format_number(F.floor(v + 0.5), 0), ",", " "), F.lit(" b/s"))
        return reduce(lambda out, x: out.when(v < x[0], x[1]), texts[:-1], F.when(v < 10_000, small)).otherwise(texts[-1][1])

    return F.array_join(F.filter(F.transform(F.transform(F.split(given, " / "), lambda part: F.abs(part.try_cast("double"))), one), lambda x: x.isNotNull()), " / ")


@dataclass(frozen=True)
class Rule:
    """A field that follows from others: the names it reads, its text, and the kinds of streams it holds for (none: all).

    beside: fields whose texts it gets after those; they may be missing.
    """

    name: str
    needs: tuple[str, ...]
    text: Callable[..., Column]
    kinds: tuple[str, ...] = ()
    numbers: bool = True
    beside: tuple[str, ...] = ()


def phased(streams: DataFrame, rules: list[Rule], columns: bool = False) -> DataFrame:
    """The streams with all rules applied in order, in as few projections as their needs allow.

    A rule joins the current projection unless it reads or fills a field that an earlier rule of the projection fills.
    """
    phase: list[Rule] = []
    fill = filled_columns if columns else filled
    for rule in rules:
        if {rule.name, *rule.needs, *rule.beside} & {x.name for x in phase}:
            streams, phase = fill(streams, [_entry(x, Look(streams, columns)) for x in phase]), []
        phase.append(rule)
    return fill(streams, [_entry(x, Look(streams, columns)) for x in phase]) if phase else streams


def _entry(rule: Rule, look: Look) -> tuple[str, Column]:
    given = [(look.number if rule.numbers else look.text)(n) for n in rule.needs]
    known = reduce(lambda a, b: a & b, (x.isNotNull() for x in given), F.col("kind").isin(*rule.kinds) if rule.kinds else F.lit(True))
    return rule.name, F.when(known, rule.text(*given, *map(look.text, rule.beside)))


def _ratio(value: Column) -> Column:
    return plain(value, 3)


def _positive(by: Column, value: Column) -> Column:
    return F.when(by > 0, value)


_PICTURE, _SOUND = ("Video",), ("Audio",)
_OWN_SIZE = lambda given, other, kind, described: F.when(kind.isin(SAMPLED) & described.isNull(), given.cast("long").cast("string"))
_BESIDE_SIZE = ("Format", "CodecID_Description")
#: Values of video and audio streams that follow from others, in this order.
VALUES = [
    Rule("Sampled_Width", ("Width", "Height"), _OWN_SIZE, _PICTURE, beside=_BESIDE_SIZE),
    Rule("Sampled_Height", ("Height", "Width"), _OWN_SIZE, _PICTURE, beside=_BESIDE_SIZE),
    Rule("PixelAspectRatio", ("DisplayAspectRatio", "Height", "Width"), lambda d, h, w: _ratio(F.try_divide(d * h, w)), _PICTURE),
    Rule("PixelAspectRatio", ("Width", "Height"), lambda w, h, d: F.when(d.isNull(), "1.000"), _PICTURE, beside=("DisplayAspectRatio",)),
    Rule("DisplayAspectRatio", ("Width", "PixelAspectRatio", "Height"), lambda w, p, h: _ratio(F.try_divide(w * p, h)), _PICTURE),
    Rule("FrameCount", ("Duration", "FrameRate"), lambda d, r: F.rint(d / 1000 * r).cast("long").cast("string"), _PICTURE),
    Rule("Duration", ("FrameCount", "FrameRate"), lambda n, r: _positive(r, whole(F.try_divide(n, r) * 1000)), _PICTURE),
    Rule("Duration", ("StreamSize", "BitRate"), lambda n, r: _positive(r, whole(F.try_divide(n * 8, r) * 1000)), _SOUND),
    Rule("FrameRate", ("SamplingRate", "SamplesPerFrame"), lambda r, n: _ratio(F.try_divide(r, n)), _SOUND),
    Rule("SamplingCount", ("Duration", "SamplingRate"), lambda d, r: whole(d / 1000 * r), _SOUND),
    Rule("Source_FrameCount", ("Source_Duration", "FrameRate"), lambda d, r: whole(d / 1000 * r), _SOUND),
    *(Rule(f"{n}/String2", (n,), channel_positions, _SOUND, False) for n in ("ChannelPositions", "ChannelPositions_Original", "Matrix_ChannelPositions")),
    Rule("BitRate", ("StreamSize", "Duration"), lambda n, d: _positive(d, whole(F.try_divide(n * 8 * 1000, d))), _PICTURE + _SOUND),
    Rule("Bits-(Pixel*Frame)", ("BitRate", "Width", "Height", "FrameRate"), lambda b, w, h, r: _ratio(F.try_divide(b, w * h * r)), _PICTURE),
    Rule("ColorSpace", ("ChromaSubsampling",), lambda _: F.lit("YUV"), _PICTURE, False),
]


def _entry_of(name: Column, value: Column) -> Column:
    return F.struct(name.alias("key"), value.cast("string").alias("value"))


@dataclass(frozen=True)
class Twins:
    """Fields with readable twins: share gives what the texts of one value have in common, make the suffixes and texts.

    Both get the field's name and value; in the map form these are variables of one expression for all names.
    """

    names: list[str]
    make: Callable[[Column, Column, Column, Look], list[tuple[str, Column]]]
    numbers: bool = True
    share: Callable[[Column, Column, Look], Column] = lambda n, v, look: v

    def entries(self, look: Look) -> Column:
        """An array of the twins of every field that has a value."""
        given = F.array(*(F.struct(F.lit(n).alias("n"), (look.number if self.numbers else look.text)(n).alias("v")) for n in self.names))
        own = lambda x, shared: F.array(*(_entry_of(F.concat(x["n"], F.lit(suffix)), value) for suffix, value in self.make(x["n"], x["v"], shared, look)))
        return F.flatten(F.transform(F.filter(given, lambda x: x["v"].isNotNull()), lambda x: let(self.share(x["n"], x["v"], look), lambda shared: own(x, shared))))

    def of(self, name: str, look: Look) -> Entries:
        """The twins of one field."""
        n, v = F.lit(name), (look.number if self.numbers else look.text)(name)
        return [(name + suffix, F.when(v.isNotNull(), value)) for suffix, value in self.make(n, v, self.share(n, v, look), look)]


def _shared_times(n: Column, v: Column, look: Look) -> Column:
    return f.duration_strings(v, F.when((n == "Duration") & F.col("kind").isin("Video", "General"), look.number("FrameRate")))


def _times(n: Column, v: Column, s: Column, look: Look) -> list[tuple[str, Column]]:
    """A duration in two units, in all, as a clock, as a clock with frames, and as both; delays of nothing have the clock alone."""
    long, there = n == "Duration", ~n.isin(DELAYS) | (v != 0)
    shown = [("s2", there), ("s1", there), ("s2", there), ("s3", F.lit(True)), ("s4", long), ("s5", long)]
    return [(f"/String{k or ''}", F.when(keep, s[own])) for k, (own, keep) in enumerate(shown)]


def _plural(n: Column, one: Column) -> Column:
    count = n.cast("long")
    return F.concat(count.cast("string"), F.lit(" "), one, F.when(count == 1, "").otherwise("s"))


def _frame_rates(n: Column, v: Column, _: Column, look: Look) -> list[tuple[str, Column]]:
    per_frame, sound = look.number("SamplesPerFrame"), (F.col("kind") == "Audio") & (n == "FrameRate")
    shown = F.concat(decimals(v, 3), F.lit(" FPS"), F.when(sound & (per_frame != 0), F.concat(F.lit(" ("), per_frame.cast("long").cast("string"), F.lit(" SPF)"))).otherwise(""))
    return [("/String", F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & ~(sound & look.number("SamplingRate").isNull()), shown))]


def _ratios(n: Column, v: Column, _: Column, look: Look) -> list[tuple[str, Column]]:
    named = reduce(lambda chain, x: chain.when(F.abs(v - x[0]) < 0.011, x[1]), f.ASPECT_NAMES[1:], F.when(F.abs(v - f.ASPECT_NAMES[0][0]) < 0.011, f.ASPECT_NAMES[0][1]))
    return [("/String", named.otherwise(F.concat(plain(v, 3), F.lit(":1"))))]


def _counts(n: Column, v: Column, _: Column, look: Look) -> list[tuple[str, Column]]:
    return [("/String", _plural(v, F.when(n.isin(BITS), "bit").when(n.isin(CHANNELS), "channel").otherwise("frame")))]


def _sizes(n: Column, v: Column, texts: Column, look: Look) -> list[tuple[str, Column]]:
    """Sizes in binary units, with their share of the file where that is known; a file's own size is told of its General row."""
    total = F.coalesce(F.nullif(look.number("FileSize"), F.lit(0.0)), look.total)
    whole_file, own = n == "FileSize", (n != "FileSize") | (F.col("kind") == "General")
    share = F.when(~whole_file & (total >= v), F.concat(F.get(texts, F.lit(0)), F.lit(" ("), whole(F.try_divide(v, total) * 100), F.lit("%)")))
    shown = [F.coalesce(share, F.get(texts, F.lit(0))), *(F.get(texts, F.lit(k)) for k in range(1, 5)), share]
    part = F.when(~whole_file & (total >= v), plain(F.try_divide(v, total), 5))
    return [*((f"/String{k or ''}", F.when(own, x)) for k, x in enumerate(shown)), ("_Proportion", part)]


def _coded(n: Column, t: Column, _: Column, look: Look) -> list[tuple[str, Column]]:
    """Words of codes; conditions on a name that is fixed are gone from the plan."""
    word = lambda words: reduce(lambda out, x: F.when(t == x[0], x[1]).otherwise(out), words.items(), t)
    return [("/String", reduce(lambda out, x: F.when(n == x[0], word(x[1])).otherwise(out), WORDS.items(), t))]


#: Readable twins, in the order in which they fill fields.
TWINS = [
    Twins(DURATIONS + DELAYS, _times, share=_shared_times), Twins(BIT_RATES, lambda n, t, _, look: [("/String", look.rate_text(t))], numbers=False), Twins(FRAME_RATES, _frame_rates), Twins(["DisplayAspectRatio"], _ratios),
    Twins(["SamplingRate"], lambda n, v, _, look: [("/String", F.when(v < 10_000, F.concat(decimals(v, 0), F.lit(" Hz"))).otherwise(F.concat(significant(v / 1000, 3), F.lit(" kHz"))))]),
    Twins(PIXELS, lambda n, v, _, look: [("/String", F.concat(decimals(v, 0), F.lit(" pixels")))]), Twins([*BITS, *CHANNELS, "Format_Settings_RefFrames"], _counts),
    Twins(["FileSize", *SIZES], _sizes, share=lambda n, v, look: size_texts(v)), Twins([*WORDS, *SAME], _coded, numbers=False), Twins(["ReplayGain_Gain", "Album_ReplayGain_Gain"], lambda n, t, _, look: [("/String", F.concat(t, F.lit(" dB")))], numbers=False),
]


def _words(look: Look) -> Entries:
    """Texts with a unit, and texts whose parts are told apart."""
    points, frames = look.text("Format_Settings_GMC"), look.text("Interleave_VideoFrames")
    out = [("Format_Settings_GMC/String", F.when(points == "0", "No warppoints").otherwise(F.concat(points, F.lit(" warppoints"))))]
    out.append(("Interleave_Preload/String", F.concat(look.text("Interleave_Preload"), F.lit("  ms"))))
    out.append(("Interleave_Duration/String", F.concat(look.text("Interleave_Duration"), F.lit("  ms"), F.coalesce(F.concat(F.lit(" ("), frames, F.lit(" video frame)")), F.lit("")))))
    for base in ("Encoded_Library", "Encoded_Application"):
        given, name, version, date = look.text(base), look.text(f"{base}_Name"), look.text(f"{base}_Version"), look.text(f"{base}_Date")
        parts = F.when(name.isNull() & (F.instr(given, " - ") > 0), F.split(given, " - ", 2))
        dated = F.when(given.isNotNull(), F.concat(F.lit("("), date, F.lit(")")))  # a date is told only beside the field itself
        out += [(f"{base}/String", F.coalesce(F.when(name.isNotNull(), F.concat_ws(" ", name, version, dated)), F.array_join(parts, " "), given)), (f"{base}_Name", F.get(parts, F.lit(0))), (f"{base}_Version", F.get(parts, F.lit(1)))]
    return out


def _with_tables(streams: DataFrame, look: Look) -> DataFrame:
    """The streams with what the tables know of their format (`__f`) and codec id (`__c`)."""
    spark = streams.sparkSession
    group = F.when(F.col("kind").isin("General", "Image"), F.col("kind")).otherwise("Stream")
    formats = F.broadcast(tables.format_table(spark).select(F.col("kind_group").alias("__group"), F.col("format").alias("__format"), F.struct("info", "url", "extensions", "commercial", "mime").alias("__f")))
    codecs = F.broadcast(tables.codec_table(spark).select(F.col("codec").alias("__codec"), F.struct("info", "hint", "url", "description").alias("__c")))
    return streams.join(formats, (group == F.col("__group")) & (look.text("Format") == F.col("__format")), "left").join(codecs, look.text("CodecID") == F.col("__codec"), "left")


def _names(look: Look) -> list[tuple[bool, Entries]]:
    """Three phases of names: whether they replace what is there, and their entries."""
    format_ = look.text("Format")
    version = F.regexp_extract(look.text("Format_Version"), "^Version (.*)$", 1)
    commercial = F.when((format_ == "MPEG Video") & (version != ""), F.concat(F.lit("MPEG-"), version, F.lit(" Video")))
    unique = F.when(F.col("kind") == "General", F.when(look.text("UniqueID").rlike("^[0-9]+$"), F.concat(look.text("UniqueID"), F.lit(" (0x"), hexadecimal(look.text("UniqueID")), F.lit(")"))))
    told = [
        ("Format/String", F.concat_ws(" ", format_, look.text("Format_AdditionalFeatures"))), ("Format/Info", F.col("__f.info")), ("Format/Url", F.col("__f.url")), ("Format_Commercial", F.coalesce(F.nullif(F.col("__f.commercial"), F.lit("")), format_)),
        ("InternetMediaType", F.col("__f.mime")), ("Format/Extensions", F.when(F.col("kind") == "General", F.col("__f.extensions"))),
        ("CodecID/Info", F.col("__c.info")), ("CodecID/Hint", F.col("__c.hint")), ("CodecID/Url", F.col("__c.url")), ("CodecID_Description", F.col("__c.description")), ("ID/String", look.text("ID")), ("UniqueID/String", unique),
    ]
    other = F.when((look.text("Format_Commercial") != format_) & (format_ != "MPEG Video"), look.text("Format_Commercial"))
    return [(True, [("Format_Commercial", commercial)]), (False, told), (False, [("Format_Commercial_IfAny", other)])]


def with_names(streams: DataFrame) -> DataFrame:
    """What the tables know of formats and codec ids, and the format's own name with its additional features."""
    named = _with_tables(streams, Look(streams))
    for over, entries in _names(Look(named)):
        named = filled(named, entries, over)
    return named.select(*streams.columns)


def name_columns(streams: DataFrame) -> DataFrame:
    """`with_names` for streams with a column per field; a plan computes the names that are read of it."""
    named = _with_tables(streams, Look(streams, columns=True))
    for k in range(3):
        over, entries = _names(Look(named, columns=True))[k]
        named = filled_columns(named, entries, over)
    return named.drop("__group", "__format", "__f", "__codec", "__c")


@F.arrow_udf(StringType())
def hexadecimal(values: pa.Array) -> pa.Array:
    """Decimal digits of any length as hexadecimal ones; it sees the rows that a condition around it leaves out, too."""
    return pa.array([f"{int(v):X}" if v and v.isascii() and v.isdigit() else None for v in values.to_pylist()], pa.string())


def with_values(streams: DataFrame) -> DataFrame:
    """Values that follow from others, and then the readable twins of all values; a column file_size gives the bytes of the stream's file."""
    names = streams.columns
    out = phased(streams.withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>"))), VALUES)
    look = Look(streams)
    for k in range(0, len(TWINS), 5):
        out = filled(out, F.concat(*(x.entries(look) for x in TWINS[k : k + 5])))
    return filled(out, _words(look)).select(*names)


def value_columns(streams: DataFrame, wanted: list[str], rate_text: Callable[[Column], Column] = bit_rate_text) -> DataFrame:
    """`with_values` for streams with a column per field: the wanted fields, and the values that others follow from; rate_text writes bit rates."""
    out = phased(streams, VALUES, columns=True)
    look = Look(out, columns=True, rate_text=rate_text)
    entries = [e for x in TWINS for n in x.names if any(w.startswith((f"{n}/", f"{n}_")) for w in wanted) for e in x.of(n, look)] + _words(look)
    return filled_columns(out, [(n, v) for n, v in entries if n in wanted])


def with_numbers(streams: DataFrame, columns: bool = False) -> DataFrame:
    """Kind, number in the kind, place where the kind has several, and how many the kind has."""
    own = Window.partitionBy("file", "kind")
    out = streams.withColumn("__n", F.count(F.lit(1)).over(own))
    entries = [("StreamKind", F.col("kind")), ("StreamKind/String", F.col("kind")), ("StreamCount", F.col("__n")), ("StreamKindID", F.col("idx")), ("StreamKindPos", F.when(F.col("__n") > 1, F.col("idx") + 1))]
    return (filled_columns if columns else filled)(out, entries, over=True).drop("__n")


def file_totals(streams: DataFrame) -> DataFrame:
    """file and totals, a map of what a file's streams tell of it: counts, lists, modes, the first video's rate, the longest duration, the bytes of all.

    One aggregate by file with partial sums; lists keep one entry a stream, empty where unknown, as long as any stream has one.
    """
    own = streams.filter("kind <> 'General'")
    entries, aggregates = [], []
    text_of = lambda n: F.coalesce(text(n), F.lit(""))
    hinted = F.when((text_of("CodecID/Hint") == "") | (text_of("Format/String") == ""), text_of("Format/String")).otherwise(F.concat(text_of("Format/String"), F.lit(" ("), text_of("CodecID/Hint"), F.lit(")")))
    for kind in KINDS[1:]:
        mine = F.col("kind") == kind
        aggregates.append(F.count_if(mine).alias(f"{kind}Count"))
        entries.append((f"{kind}Count", F.when(F.col(f"{kind}Count") > 0, F.col(f"{kind}Count"))))
        for name, value in (("Format_List", text_of("Format/String")), ("Format_WithHint_List", hinted), ("Language_List", text_of("Language/String"))):
            listed = F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("idx", value.alias("v"))))), lambda x: x["v"])
            aggregates.append(listed.alias(f"{kind}_{name}"))
            joined = F.when(F.exists(F.col(f"{kind}_{name}"), lambda x: x != ""), F.array_join(F.col(f"{kind}_{name}"), " / "))
            entries += [(f"{kind}_{name}", joined)] + ([(f"{kind}_Codec_List", joined)] if name == "Format_List" else [])
    first = F.when(F.col("kind") == "Video", F.col("idx"))
    for name in ("FrameRate", "FrameRate/String", "FrameCount"):
        aggregates.append(F.min_by(text(name), first).alias(f"first {name}"))
        rate = F.col("first FrameRate").isNotNull() if name == "FrameRate/String" else F.lit(True)
        entries.append((name, F.when(rate, F.col(f"first {name}"))))
    alone = ["Encoded_Library", "Encoded_Library_Settings", "Encoded_Library_Name", "Encoded_Library_Version", "Encoded_Library/String"]
    aggregates += [F.count(F.lit(1)).alias("streams"), F.max(number("Duration")).alias("longest"), overall_mode(text("BitRate_Mode"), F.col("kind")).alias("mode"), known_total(number("StreamSize").cast("long")).alias("bytes")]
    aggregates += [F.max(text("Format")).alias("format"), F.max(text("Encoded_Library_Settings").isNotNull() | (F.col("kind") == "Audio")).alias("encoded"), *(F.max(text(n)).alias(f"alone {n}") for n in alone)]
    entries += [("Duration", whole(F.col("longest"))), ("OverallBitRate_Mode", F.col("mode"))]
    # Only where the single stream of an elementary file has the file's own format.
    entries += [(f"alone/{n}", F.when((F.col("streams") == 1) & F.col("encoded") & (F.col("format") != "FLAC"), F.col(f"alone {n}"))) for n in alone]
    entries += [("alone/Format", F.col("format")), ("bytes", F.col("bytes"))]
    grouped = own.groupBy("file").agg(*aggregates)
    given = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in entries)), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return grouped.select("file", F.map_from_entries(given).alias("totals"))


def with_totals(general: DataFrame, totals: DataFrame) -> DataFrame:
    """General rows with what their streams tell of them, and with what follows: bit rate and the bytes beside the streams."""
    joined = general.join(totals, "file", "left").withColumn("totals", F.coalesce("totals", F.create_map().cast("map<string,string>")))
    same = F.coalesce(F.element_at("totals", F.lit("alone/Format")), F.lit("")) == F.coalesce(text("Format"), F.lit(""))
    alone = F.transform_keys(F.map_filter("totals", lambda k, _: k.startswith("alone/Encoded") & same), lambda k, _: F.substring(k, F.lit(7), F.length(k)))
    own = F.map_concat(F.map_filter("totals", lambda k, _: ~k.startswith("alone/") & (k != "bytes")), alone)
    missing = F.map_filter(own, lambda k, _: F.coalesce(F.element_at("fields", k), F.lit("")) == "")
    kept = F.map_filter("fields", lambda k, v: F.coalesce(v, F.lit("")) != "")
    size, streams = number("FileSize"), F.element_at("totals", F.lit("bytes")).cast("long")
    out = joined.withColumn("fields", F.map_concat(kept, missing))
    out = filled(out, [("OverallBitRate", F.when(number("Duration") > 0, whole(F.try_divide(size * 8 * 1000, number("Duration"))))), ("StreamSize", F.when(size.cast("long") >= streams, size.cast("long") - streams))])
    return out.select(*general.columns)


def derived(streams: DataFrame) -> DataFrame:
    """All phases in order, over rows of file, kind, idx, fields: streams first, then the files from them, then the numbers.

    The streams are written to the checkpoint folder once they are done. A file's size comes from its General row. Extensions that don't belong to the format are told last.
    """
    sizes = streams.filter("kind = 'General'").groupBy("file").agg(F.max(number("FileSize")).alias("file_size"))
    columns = streams.columns
    parts = checkpointed(with_values(with_names(streams.filter("kind <> 'General'").join(sizes, "file", "left"))))  # read twice
    general = with_totals(with_names(streams.filter("kind = 'General'")), file_totals(parts)).withColumn("file_size", F.lit(None).cast("double"))
    known = F.split(text("Format/Extensions"), " ")
    invalid = F.when(~F.array_contains(known, F.lower(text("FileExtension"))), text("Format/Extensions"))
    whole_ = filled(with_values(general), [("FileExtension_Invalid", invalid)])
    return with_numbers(parts.unionByName(whole_)).select(*columns)
