"""Languages, file names, text cleaning, escapes, and time strings as Catalyst columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two-letter code, three-letter code, older three-letter code, name. A longer table is passed as a parameter.
LANGUAGES = [
    ("ar", "ara", "ara", "Arabic"), ("bg", "bul", "bul", "Bulgarian"), ("ca", "cat", "cat", "Catalan"), ("cs", "ces", "cze", "Czech"), ("da", "dan", "dan", "Danish"), ("de", "deu", "ger", "German"),
    ("el", "ell", "gre", "Greek"), ("en", "eng", "eng", "English"), ("es", "spa", "spa", "Spanish"), ("et", "est", "est", "Estonian"), ("fa", "fas", "per", "Persian"), ("fi", "fin", "fin", "Finnish"),
    ("fr", "fra", "fre", "French"), ("he", "heb", "heb", "Hebrew"), ("hi", "hin", "hin", "Hindi"), ("hr", "hrv", "hrv", "Croatian"), ("hu", "hun", "hun", "Hungarian"), ("id", "ind", "ind", "Indonesian"),
    ("it", "ita", "ita", "Italian"), ("ja", "jpn", "jpn", "Japanese"), ("ko", "kor", "kor", "Korean"), ("lt", "lit", "lit", "Lithuanian"), ("lv", "lav", "lav", "Latvian"), ("nl", "nld", "dut", "Dutch"),
    ("pl", "pol", "pol", "Polish"), ("pt", "por", "por", "Portuguese"), ("ro", "ron", "rum", "Romanian"), ("ru", "rus", "rus", "Russian"), ("sk", "slk", "slo", "Slovak"), ("sl", "slv", "slv", "Slovenian"),
    ("sv", "swe", "swe", "Swedish"), ("th", "tha", "tha", "Thai"), ("tr", "tur", "tur", "Turkish"), ("uk", "ukr", "ukr", "Ukrainian"), ("vi", "vie", "vie", "Vietnamese"), ("zh", "zho", "chi", "Chinese"),
]


def language_codes(spark: SparkSession, languages: list[tuple[str, str, str, str]] = LANGUAGES) -> DataFrame:
    """A row per code of each language: code, two, three, name. At most three rows per table entry, so it is broadcast."""
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + f", {k})" for k, row in enumerate(languages))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(two, three, older, name, place)")
    codes = rows.select(F.explode(F.array_distinct(F.array("two", "three", "older"))).alias("code"), "two", "three", "name", "place").filter("code <> ''")
    return codes.groupBy("code").agg(*(F.min_by(c, "place").alias(c) for c in ("two", "three", "name")))


def with_language(rows: DataFrame, column: str, languages: list[tuple[str, str, str, str]] = LANGUAGES) -> DataFrame:
    """Adds normal (code with upper-case region), full (name with region), two, three and either."""
    codes = F.broadcast(language_codes(rows.sparkSession, languages))
    given = F.col(column)
    base, region = F.regexp_extract(given, "^([^-_]*)", 1), F.upper(F.regexp_extract(given, "^[^-_]*[-_](.*)$", 1))
    tagged = given.rlike("[-_]")
    joined = rows.withColumns({"__base": F.lower(F.trim(base)), "__region": region}).join(codes, F.col("__base") == F.col("code"), "left")
    known = F.col("code").isNotNull()
    tail = F.when(tagged, F.concat(F.lit("-"), "__region")).otherwise("")
    own = F.when(known, F.when(F.col("two") != "", F.col("two")).otherwise(F.col("three"))).otherwise(F.lower(base))
    full = F.when(known, F.concat("name", F.when(tagged, F.concat(F.lit(" ("), "__region", F.lit(")"))).otherwise(""))).otherwise(given)
    two = F.when(known & (F.col("two") != ""), F.concat("two", tail)).otherwise("")
    three = F.when(known, F.concat("three", tail)).otherwise("")
    either = F.when(~known, given).when(two != "", two).otherwise(three)
    return joined.select(*rows.columns, F.concat(own, tail).alias("normal"), full.alias("full"), two.alias("two_letters"), three.alias("three_letters"), either.alias("either"))


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path part; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def file_parts(path: Column) -> Column:
    """Struct folder, name (without extension), extension (case kept)."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    has = file.rlike(r"^.+\.[^.]*$")
    return F.struct(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.when(has, F.regexp_extract(file, r"^(.+)\.[^.]*$", 1)).otherwise(file).alias("name"), F.when(has, F.regexp_extract(file, r"^.+\.([^.]*)$", 1)).otherwise("").alias("extension"))


def clean_text(text: Column) -> Column:
    """Control characters but line feeds and tabs dropped, outer white space trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"^\s+|\s+$", "")


def xml_escape(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    escaped = F.regexp_replace(reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, text), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(text.rlike(r'[&<>"\x00-\x1F]'), escaped).otherwise(text)


def json_escape(text: Column) -> Column:
    """A JSON string with quotes; characters beyond ASCII stay."""
    replaced = lambda out, pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, out)
    controls = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), *((chr(k), f"\\u{k:04x}") for k in range(32) if k not in (9, 10, 13))]
    plain = replaced(text, [("\\", "\\\\"), ('"', '\\"')])
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), replaced(plain, controls)).otherwise(plain), F.lit('"'))


def export_name(name: Column) -> Column:
    """Element name: brackets dropped, punctuation to underscores, a leading digit gets one before it."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[()]", ""), r"[^\p{L}\p{N}_]", "_")
    return F.when(plain == "", "_").when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def ms_to_seconds(text: Column) -> Column:
    """Milliseconds in text to seconds with three more decimals; what isn't a number stays."""
    from reelframe.functions.formatters import fixed

    trimmed = F.trim(text)
    value = trimmed.try_cast("double")
    decimals = F.when(F.instr(trimmed, ".") > 0, F.length(F.split_part(trimmed, F.lit("."), F.lit(2)))).otherwise(0) + 3
    return F.when(value.isNull(), trimmed).otherwise(fixed(value / 1000.0, decimals.cast("int")))


def track_position(text: Column) -> Column:
    """Struct position and total of `3/12`."""
    return F.struct(F.trim(F.split_part(text, F.lit("/"), F.lit(1))).alias("position"), F.trim(F.split_part(text, F.lit("/"), F.lit(2))).alias("total"))


def channel_positions(text: Column) -> Column:
    """`Front: L C R, Side: L R, LFE` to `3/2/0.1`."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    count = lambda name: F.aggregate(F.filter(parts, lambda p: F.trim(F.split_part(p, F.lit(":"), F.lit(1))) == name), F.lit(0), lambda n, p: n + F.when(F.instr(p, ":") > 0, words(F.regexp_extract(p, r":(.*)$", 1))).otherwise(0))
    low = F.size(F.filter(parts, lambda p: F.upper(p) == "LFE"))
    base = F.concat_ws("/", *(count(n).cast("string") for n in ("Front", "Side", "Back")))
    return F.when(low > 0, F.concat(base, F.lit("."), low.cast("string"))).when(F.contains(text, F.lit("LFE")), F.concat(base, F.lit(".0"))).otherwise(base)


def clock_to_ms(text: Column, pattern: str) -> Column:
    """Milliseconds of a time by a pattern of four groups (hours may be empty; fractions are padded on the right)."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    valid = text.rlike(pattern) & (number(part(2)) <= 59) & (number(part(3)) <= 59)
    return F.when(valid, ((number(part(1)) * 60 + number(part(2))) * 60 + number(part(3))) * 1000 + number(F.rpad(part(4), 3, "0")))


def timecode(frames: Column, rate: int) -> Column:
    """A count of frames as `HH:MM:SS:FF`; parts have two digits at least, and hours go on beyond 99."""
    part = lambda by: ((frames - frames % by) / by).cast("long")
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.lit(2), F.length(x.cast("string"))), F.lit("0"))
    return F.concat_ws(":", *(two(x) for x in (part(3600 * rate), part(60 * rate) % 60, part(rate) % 60, frames % rate)))


#: Time formats of subtitle files.
SRT_TIME = r"^\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*$"
VTT_TIME = r"^\s*(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})\s*$"
ASS_TIME = r"^\s*(\d+):(\d{1,2}):(\d{1,2})\.(\d{1,3})\s*$"
VOBSUB_TIME = r"^\s*(\d+):(\d{2}):(\d{2}):(\d{3})\s*$"

#: Seconds between other epochs and 1970.
MAC_EPOCH, MATROSKA_EPOCH, FILETIME_EPOCH = 2_082_844_800, 978_307_200, 11_644_473_600


def utc_text(seconds: Column) -> Column:
    return F.concat(F.lit("UTC "), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def unwrapped(ticks: Column, first: Column) -> Column:
    """Milliseconds of a 33-bit 90 kHz clock that may have started anew since first."""
    return (ticks + F.when(ticks + F.lit(1 << 32) < first, F.lit(1 << 33)).otherwise(F.lit(0).cast("long"))) / 90


def hms_to_ms(text: Column) -> Column:
    """Milliseconds (double) of `HH:MM:SS.nnnnnnnnn`, as duration tags have it; null where one of the first three parts is no number."""
    parts = F.split(F.trim(text), ":")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return ((part(0) * 60.0 + part(1)) * 60.0 + part(2)) * 1000.0
