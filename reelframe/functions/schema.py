"""The core fields of every kind of stream with their measures and options, and the labels of text reports.

A longer table is a parameter wherever this one is the default (operators/schema.py): any rows of kind, slot, name, measure,
options and label will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, measure and options of fields. Options: first, shown in the text report; fourth, type; fifth, exported.
GENERAL = """
Count||N NI
StreamKind||N NT
StreamKindID||N NI
StreamOrder||N YIY
ID||N YTY
ID/String||Y NT
UniqueID||N YTY
VideoCount||N NIY
AudioCount||N NIY
CompleteName||Y YT
FileExtension||N NTY
Format||N YTY
Format/String||Y NT
Format_Commercial||N NT
Format_Version||Y YTY
Format_Profile||Y YTY
CodecID||N YTY
FileSize| byte|N YTY
FileSize/String||Y NT
Duration| ms|N YFY
Duration/String||Y NT
OverallBitRate| bps|N YFY
OverallBitRate/String||Y NT
FrameRate| fps|N YFY
FrameCount||N NIY
StreamSize| byte|N YIY
Title||N NTY
Album||Y YTY
Performer||Y YTY
Encoded_Date||Y YTY
Encoded_Application||N YTY
"""
VIDEO = """
Count||N NI
StreamKind||N NT
StreamKindID||N NI
StreamOrder||N YIY
ID||N YTY
ID/String||Y NT
Format||N YTY
Format/String||Y NT
Format_Version||Y YTY
Format_Profile||Y YTY
CodecID||Y YTY
Duration| ms|N YFY
Duration/String||Y NT
BitRate_Mode||N YTY
BitRate| bps|N YFY
BitRate/String||Y NT
Width| pixel|N YIY
Width/String||Y NT
Height| pixel|N YIY
Height/String||Y NT
DisplayAspectRatio||N YFY
DisplayAspectRatio/String||Y NT
FrameRate| fps|N YFY
FrameRate/String||Y NT
FrameCount||N NIY
BitDepth| bit|N YIY
BitDepth/String||Y NT
Delay| ms|N NFY
StreamSize| byte|N YIY
StreamSize/String||Y NT
Title||Y YTY
Language||N YTY
Language/String||Y NT
"""
AUDIO = """
Count||N NI
StreamKind||N NT
StreamKindID||N NI
StreamOrder||N YIY
ID||N YTY
ID/String||Y NT
Format||N YTY
Format/String||Y NT
Format_Version||Y YTY
Format_Profile||Y YTY
CodecID||Y YTY
Duration| ms|N YFY
Duration/String||Y NT
BitRate_Mode||N YTY
BitRate| bps|N YFY
BitRate/String||Y NT
Channel(s)| channel|N YIY
Channel(s)/String||Y NT
ChannelLayout||Y YTY
SamplingRate| Hz|N YFY
SamplingRate/String||Y NT
BitDepth| bit|N YIY
BitDepth/String||Y NT
Delay| ms|N NFY
StreamSize| byte|N YIY
StreamSize/String||Y NT
Title||Y YTY
Language||N YTY
Language/String||Y NT
"""
TEXT = """
Count||N NI
StreamKind||N NT
StreamKindID||N NI
StreamOrder||N YIY
ID||N YTY
ID/String||Y NT
Format||N YTY
Format/String||Y NT
CodecID||Y YTY
Duration| ms|N YFY
Duration/String||Y NT
StreamSize| byte|N YIY
Title||Y YTY
Language||N YTY
Language/String||Y NT
"""
#: Labels that differ from their field's name.
LABELS = """
ID/String|ID
UniqueID|Unique ID
CompleteName|Complete name
Format/String|Format
Format_Commercial|Commercial name
Format_Version|Format version
Format_Profile|Format profile
CodecID|Codec ID
FileSize/String|File size
Duration/String|Duration
OverallBitRate/String|Overall bit rate
BitRate_Mode|Bit rate mode
BitRate|Bit rate
BitRate/String|Bit rate
Width/String|Width
Height/String|Height
DisplayAspectRatio/String|Display aspect ratio
FrameRate|Frame rate
FrameRate/String|Frame rate
BitDepth|Bit depth
BitDepth/String|Bit depth
Channel(s)/String|Channel(s)
ChannelLayout|Channel layout
SamplingRate/String|Sampling rate
StreamSize/String|Stream size
Title|Title
Encoded_Date|Encoded date
Encoded_Application|Writing application
Language/String|Language
"""
#: The kinds in the order of reports.
KINDS = ["General", "Video", "Audio", "Text", "Other", "Image", "Menu"]


def labels() -> dict[str, str]:
    return dict(line.split("|") for line in LABELS.split("\n") if line)


def label_of(name: str, known: dict[str, str]) -> str:
    return known.get(name) or known.get(name.removesuffix("/String"), name)


def core_rows() -> list[tuple[str, int, str, str, str]]:
    """kind, slot, name, measure and options of every core field."""
    tables = {"General": GENERAL, "Video": VIDEO, "Audio": AUDIO, "Text": TEXT}
    return [(kind, slot, *line.split("|")) for kind, text in tables.items() for slot, line in enumerate(x for x in text.split("\n") if x)]


def core(spark: SparkSession) -> DataFrame:
    """The core fields as a dimension: kind, slot, name, measure, options, label."""
    known = labels()
    rows = ", ".join(f"('{kind}', {slot}, '{name}', '{measure}', '{options}', '{label_of(name, known)}')" for kind, slot, name, measure, options in core_rows())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, slot, name, measure, options, label)")  # of a known size, so that Spark may broadcast it


def label(name: Column) -> Column:
    """The label of a field that isn't in the dimension."""
    table = F.create_map(*(F.lit(x) for pair in labels().items() for x in pair))
    return F.coalesce(F.element_at(table, name), F.element_at(table, F.regexp_replace(name, "/String$", "")), name)
