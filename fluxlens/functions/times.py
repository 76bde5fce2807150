"""Times and units as text, bins, and checksums."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units of an interval in seconds; a year has 52 weeks
UNITS = (("y", 31449600), ("w", 604800), ("d", 86400), ("h", 3600), ("m", 60))


def iso_time(seconds: Column, utc: bool = True) -> Column:
    """yyyy-mm-ddThh:mm:ss of epoch seconds, in UTC or in the session's time zone."""
    if utc:
        at = F.timestamp_add("SECOND", seconds.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    else:
        at = F.timestamp_seconds(seconds)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def interval_time(seconds: Column) -> Column:
    """Like 1d2h3m4s: units that are zero are left out, seconds never."""
    left = seconds.cast("long")
    parts = []
    for name, size in UNITS:
        count = F.floor(left / size)
        parts.append(F.when(count > 0, F.concat(count.cast("string"), F.lit(name))).otherwise(""))
        left = left % size
    return F.concat(*parts, left.cast("string"), F.lit("s"))


def interval_time_ms(ms: Column) -> Column:
    """:func:`interval_time` of whole seconds, a point, and three digits of milliseconds."""
    ms = ms.cast("long")
    return F.concat(interval_time(F.floor(ms / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def iso_units(x: Column) -> Column:
    """Whole number of the largest of E, T, G, M, K (powers of 1000) that x reaches; below, the number itself."""
    out = x.cast("long").cast("string")
    for power, unit in ((1, "K"), (2, "M"), (3, "G"), (4, "T"), (6, "E")):
        size = 1000**power
        out = F.when(x >= size, F.concat(F.floor(x / size).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def quantise(seconds: Column, width: int = 300) -> Column:
    """Start of the bin of ``width`` seconds."""
    return (F.floor(seconds / width) * width).cast("long")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def hex_dump(data: Column) -> Column:
    return F.lower(F.hex(data))


def crc(data: bytes, value: int = 0) -> int:
    """CRC-32 as flow logs have it: starts from zero and isn't inverted at the end."""
    return zlib.crc32(data, value ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def parse_number(text: str) -> int:
    """Unsigned number as C writes it: decimal, 0x hexadecimal, 0 octal."""
    digits = text.lower()
    if digits.startswith("0x"):
        return int(digits, 16)
    return int(digits, 8) if len(digits) > 1 and digits.startswith("0") else int(digits, 10)
