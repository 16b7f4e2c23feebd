"""Human-readable strings of sizes, durations, rates and ratios as Catalyst columns.

Values whose divisor is a power of two are rounded with integers, half to even. Fixed decimals of doubles round the
exact binary value, which no built-in function does, so they go through one vectorised Arrow function.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Size units by powers of 1024.
SIZE_UNITS = ["Byte", "KiB", "MiB", "GiB", "TiB", "PiB"]
#: Ratio, its name; the first within 0.011 is taken.
ASPECT_NAMES = [(1.0, "1.000"), (1.2, "6:5"), (1.222, "11:9"), (1.25, "5:4"), (1.333, "4:3"), (1.5, "3:2"), (1.6, "16:10"), (1.667, "5:3"), (1.778, "16:9"), (1.85, "1.85:1"), (2.2, "2.2:1"), (2.35, "2.35:1"), (2.4, "2.40:1")]
#: Numerators over 1001 of broadcast frame rates.
NTSC_NUMERATORS = [24000, 30000, 60000, 48000, 120000]


@F.arrow_udf(StringType())
def _fixed(values: pa.Array, decimals: pa.Array) -> pa.Array:
    return pa.array([None if v is None or d is None else f"{v:.{d}f}" for v, d in zip(values.to_pylist(), decimals.to_pylist(), strict=True)], pa.string())


def fixed(value: Column, decimals: Column | int) -> Column:
    """Fixed decimals of a double, its exact binary value rounded half to even."""
    return _fixed(value.cast("double"), F.lit(decimals) if isinstance(decimals, int) else decimals)


def thousands(n: Column) -> Column:
    """Digits in groups of three with blanks between."""
    return F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit(" "))


def _grouped(text: Column) -> Column:
    whole, dot = F.split_part(text, F.lit("."), F.lit(1)), F.instr(text, ".")
    return F.concat(thousands(whole.cast("long")), F.when(dot > 0, text.substr(dot, F.length(text))).otherwise(""))


def _half_even(n: Column, scale: int, divisor: Column) -> Column:
    """round(n * scale / divisor) with ties to even, in integers."""
    product = n * F.lit(scale).cast("long")
    whole, rest = (product - product % divisor) / divisor, product % divisor
    whole = whole.cast("long")
    up = (2 * rest > divisor) | ((2 * rest == divisor) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def _placed(units: Column, decimals: int) -> Column:
    """An integer count of 10**-decimals as text."""
    if not decimals:
        return units.cast("string")
    scale = 10**decimals
    whole = ((units - units % scale) / scale).cast("long").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((units % scale).cast("string"), decimals, "0"))


def _significant(n: Column, divisor: Column, digits: int) -> Column:
    """n / divisor with so many significant digits; the whole part is always kept."""
    value = n / divisor
    first = F.when(value < 10, 1).when(value < 100, 2).when(value < 1000, 3).otherwise(4)
    out = None
    for whole in (1, 2, 3, 4):
        decimals = max(0, digits - whole)
        units = _half_even(n, 10**decimals, divisor)
        # Rounding up to the next power of ten takes a digit off.
        wider = units >= 10 ** (whole + decimals)
        fewer = max(0, digits - whole - 1)
        text = F.when(wider, _placed((units / 10 ** (decimals - fewer)).cast("long"), fewer)).otherwise(_placed(units, decimals))
        out = F.when(first == whole, text) if out is None else out.when(first == whole, text)
    return F.when(n == 0, _placed(F.lit(0).cast("long"), digits - 1)).otherwise(out)


def size_string(n: Column, digits: int | None = 3) -> Column:
    """Bytes in binary units; digits None gives the nearest whole number, ties to even."""
    n = n.cast("long")
    power = reduce(lambda out, k: out.when(n < 1024 ** (k + 1), k), range(1, 5), F.when(n < 1024, 0)).otherwise(5)
    divisor = F.get(F.array(*(F.lit(1024**k).cast("long") for k in range(6))), power)
    unit = F.when(power == 0, F.when(n <= 1, "Byte").otherwise("Bytes")).otherwise(F.get(F.array(*map(F.lit, SIZE_UNITS)), power))
    number = _half_even(n, 1, divisor).cast("string") if digits is None else _significant(n, divisor, digits)
    return F.concat(number, F.lit(" "), unit)


def size_strings(n: Column) -> Column:
    """Array of the default string and the strings of 1 (whole), 2, 3 and 4 digits."""
    return F.array(size_string(n, 3), size_string(n, None), size_string(n, 2), size_string(n, 3), size_string(n, 4))


def _two(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def duration_strings(ms: Column, fps: Column | None = None) -> Column:
    """Struct s1 (all units), s2 (two units), s3 (clock), s4 (clock with frames), s5 (both clocks)."""
    total = F.round(F.abs(ms.cast("double"))).cast("long")
    part = lambda size: ((total - total % size) / size).cast("long")
    h, m, s, r = part(3_600_000), part(60_000) % 60, part(1000) % 60, total % 1000
    sign = F.when(ms < 0, "-").otherwise("")
    texts = [F.concat(v.cast("string"), F.lit(f" {u}")) for v, u in ((h, "h"), (m, "min"), (s, "s"), (r, "ms"))]
    first = F.when(h > 0, 0).when(m > 0, 1).when(s > 0, 2).otherwise(3)
    words = F.array(*texts)
    join = lambda n: F.concat(sign, F.array_join(F.slice(words, first + 1, F.lit(n)), " "))
    clock = F.concat(sign, _two(h), F.lit(":"), _two(m), F.lit(":"), _two(s))
    s3 = F.concat(clock, F.lit("."), F.lpad(r.cast("string"), 3, "0"))
    s4 = F.lit("") if fps is None else F.when(fps > 0, F.concat(clock, F.lit(":"), _two(F.floor(r.cast("double") * fps / 1000.0).cast("long")))).otherwise("")
    s5 = F.when(s4 == "", s3).otherwise(F.concat(s3, F.lit(" ("), s4, F.lit(")")))
    return F.struct(join(4).alias("s1"), join(2).alias("s2"), s3.alias("s3"), s4.alias("s4"), s5.alias("s5"))


def significant(value: Column, digits: int) -> Column:
    """A double with so many significant digits, grouped by thousands."""
    width = F.greatest(F.floor(F.log10(F.abs(value))) + 1, F.lit(1)).cast("int")
    once = fixed(value, F.greatest(F.lit(digits) - width, F.lit(0)))
    rounded = once.cast("double")
    wider = F.greatest(F.floor(F.log10(F.abs(rounded))) + 1, F.lit(1)).cast("int")
    text = F.when(wider == width, once).otherwise(fixed(rounded, F.greatest(F.lit(digits) - wider, F.lit(0))))
    return F.when(value == 0, f"{0:.{digits - 1}f}").otherwise(_grouped(text))


def bitrate_string(bps: Column) -> Column:
    """The unit is chosen first, so the number is formatted once."""
    v = F.abs(bps.cast("double"))
    small = v < 10_000
    by = F.when(v < 10_000_000, 1e3).when(v < 10_000_000_000, 1e6).otherwise(1e9)
    unit = F.when(v < 10_000_000, " kb/s").when(v < 10_000_000_000, " Mb/s").otherwise(" Gb/s")
    return F.when(small, F.concat(thousands(F.round(v)), F.lit(" b/s"))).otherwise(F.concat(significant(v / by, 3), unit))


def sampling_rate_string(hz: Column) -> Column:
    v = hz.cast("double")
    return F.when(v < 10_000, F.concat(thousands(F.round(v)), F.lit(" Hz"))).otherwise(F.concat(significant(v / 1000.0, 3), F.lit(" kHz")))


def unit_string(n: Column, one: str, many: str, group: bool = False) -> Column:
    return F.when(n == 1, f"1 {one}").otherwise(F.concat(thousands(n) if group else n.cast("string"), F.lit(f" {many}")))


def pixels_string(n: Column) -> Column:
    return F.concat(thousands(n), F.lit(" pixels"))


def frame_rate_string(fps: Column, per_frame: Column | None = None) -> Column:
    """Three decimals; per_frame adds the samples of a frame. Infinite and undefined rates are empty."""
    base = F.concat(_grouped(fixed(fps, 3)), F.lit(" FPS"))
    text = base if per_frame is None else F.when(per_frame.isNull(), base).otherwise(F.concat(base, F.lit(" ("), per_frame.cast("string"), F.lit(" SPF)")))
    return F.when(F.isnan(fps) | (F.abs(fps) == float("inf")), "").otherwise(text)


def aspect_ratio_string(ratio: Column) -> Column:
    v = ratio.cast("double")
    near = lambda x: F.abs(v - F.lit(x)) < 0.011
    chain = reduce(lambda out, x: out.when(near(x[0]), x[1]), ASPECT_NAMES[1:], F.when(near(ASPECT_NAMES[0][0]), ASPECT_NAMES[0][1]))
    return chain.otherwise(F.concat(fixed(v, 3), F.lit(":1")))


def proportion(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, "").otherwise(fixed(part.cast("double") / whole.cast("double"), 5))


def ntsc_fraction(fps: Column) -> Column:
    """Numerator over 1001 of a rate within 0.0005 of one, else null."""
    near = lambda n: F.abs(fps - F.lit(n / 1001.0)) < 0.0005
    return reduce(lambda out, n: out.when(near(n), n), NTSC_NUMERATORS[1:], F.when(near(NTSC_NUMERATORS[0]), NTSC_NUMERATORS[0]))


def compression_ratio(sampling_rate: Column, bits: Column, channels: Column, bit_rate: Column) -> Column:
    """How many times smaller a coded sound is than its samples, to three decimals; null without a positive bit rate."""
    raw = (sampling_rate.cast("long") * bits.cast("long") * channels.cast("long")).cast("double")
    return F.when(bit_rate > 0, fixed(F.try_divide(raw, bit_rate.cast("double")), 3))
