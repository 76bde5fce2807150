"""Addresses: BINARY of 4 or 16 bytes.  Networks become ranges of bytes, which reach the Parquet scan."""

from __future__ import annotations

import ipaddress
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unicast_length(family: int) -> int:
    """Prefix length of a single address: 32 for family 4, 128 for family 6."""
    return {4: 32, 6: 128}[family]


def parse_network(text: str, strict: bool = True) -> tuple[bytes, int]:
    """(address, prefix length) of ``a`` or ``a/len``; with ``strict`` host bits must be zero."""
    address, slash, length = text.partition("/")
    ip = ipaddress.ip_address(address)
    bits = unicast_length(ip.version)
    n = int(length) if slash else bits
    if not 0 <= n <= bits:
        raise ValueError(f"prefix length out of range: {text}")
    low, _ = network_range(ip.packed, n)
    if strict and slash and low != ip.packed:
        raise ValueError(f"host bits set: {text}")
    return ip.packed, n


def netmask(family: int, length: int) -> bytes:
    bits = unicast_length(family)
    return (((1 << length) - 1) << (bits - length)).to_bytes(bits // 8, "big")


def hostmask(family: int, length: int) -> bytes:
    return invert(netmask(family, length))


def invert(a: bytes) -> bytes:
    return bytes(255 - x for x in a)


def _paired(a: bytes, b: bytes) -> None:
    if len(a) != len(b):
        raise ValueError("address families differ")


def both(a: bytes, b: bytes) -> bytes:
    _paired(a, b)
    return bytes(x & y for x, y in zip(a, b, strict=True))


def either(a: bytes, b: bytes) -> bytes:
    _paired(a, b)
    return bytes(x | y for x, y in zip(a, b, strict=True))


def network_range(address: bytes, length: int) -> tuple[bytes, bytes]:
    """First and last address of the network round ``address``."""
    family = 4 if len(address) == 4 else 6
    return both(address, netmask(family, length)), either(address, hostmask(family, length))


def compare(a: bytes, b: bytes) -> int:
    """-1, 0 or 1: IPv4 before IPv6, then by value."""
    x, y = (len(a), a), (len(b), b)
    return (x > y) - (x < y)


def is_unspecified(a: bytes) -> bool:
    return not any(a)


def host_is_zeros(a: bytes, length: int) -> bool:
    return a == network_range(a, length)[0]


def host_is_ones(a: bytes, length: int) -> bool:
    return a == network_range(a, length)[1]


def pton(text: str) -> bytes:
    return ipaddress.ip_address(text).packed


def ntop(a: bytes | None) -> str | None:
    """Text of an address; IPv4-mapped and -compatible ones end in dotted form, as the C library writes them."""
    if a is None or len(a) not in (4, 16):
        return None
    return socket.inet_ntop(socket.AF_INET if len(a) == 4 else socket.AF_INET6, a)


# Column expressions


def in_network(address: Column, network: str, strict: bool = True) -> Column:
    """True if the address lies in the network; false for null and for the other family."""
    a, length = parse_network(network, strict)
    low, high = network_range(a, length)
    # without an address the first test is false, and so is the whole: no null is left to hide the range
    return address.isNotNull() & (F.length(address) == len(a)) & (address >= F.lit(low)) & (address <= F.lit(high))


def family(address: Column) -> Column:
    """4, 6, or 0 without an address."""
    return F.when(F.length(address) == 4, 4).when(F.length(address) == 16, 6).otherwise(0)


def order_key(address: Column) -> list[Column]:
    return [F.length(address), address]


def ipv4_number(address: Column) -> Column:
    return F.conv(F.hex(address), 16, 10).cast("long")


def ipv4_from_number(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def ipv4_number_text(n: Column) -> Column:
    """Dotted text of an address given as a number."""
    n = n.cast("long")
    parts = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def halves(address: Column) -> tuple[Column, Column]:
    """The upper and the lower 64 bits as longs (the upper ones of an IPv4 address are zero)."""
    text, short = F.hex(address), F.length(address) <= 8
    # one expression for each half, whatever else is asked of the address: Spark works it out once in a projection
    high = F.when(short, F.lit(0).cast("long")).otherwise(F.conv(F.substring(F.lpad(text, 32, "0"), 1, 16), 16, -10).cast("long"))
    return high, F.conv(F.right(text, F.lit(16)), 16, -10).cast("long")


def _joined(high: Column, low: Column, size: Column) -> Column:
    """An address of ``size`` bytes from its halves; null without a size."""
    tail = F.lpad(F.hex(low), 16, "0")
    return F.unhex(F.when(size == 4, F.right(tail, F.lit(8))).when(size == 16, F.concat(F.lpad(F.hex(high), 16, "0"), tail)))


def _one_size(a: Column, b: Column) -> Column:
    return F.when(F.length(a) == F.length(b), F.length(a))


def both_columns(a: Column, b: Column) -> Column:
    """Bits that both addresses have; null for two families, as for all that follows."""
    (p, q), (r, s) = halves(a), halves(b)
    return _joined(p.bitwiseAND(r), q.bitwiseAND(s), _one_size(a, b))


def either_columns(a: Column, b: Column) -> Column:
    (p, q), (r, s) = halves(a), halves(b)
    return _joined(p.bitwiseOR(r), q.bitwiseOR(s), _one_size(a, b))


def invert_column(a: Column) -> Column:
    high, low = halves(a)
    return _joined(F.bitwise_not(high), F.bitwise_not(low), F.length(a))


def _by_length(make, family: Column, length: Column) -> Column:
    """``make(family, n)`` for the column's lengths: tables of 33 and 129 values; null for a length out of range."""
    n = length.cast("int")
    tables = {f: F.array(*[F.lit(make(f, k)) for k in range(unicast_length(f) + 1)]) for f in (4, 6)}
    return F.when(n >= 0, F.when(family == 4, F.get(tables[4], n)).when(family == 6, F.get(tables[6], n)))


def netmask_column(family: Column, length: Column) -> Column:
    """The mask of a prefix length in a family (4 or 6)."""
    return _by_length(netmask, family, length)


def hostmask_column(family: Column, length: Column) -> Column:
    return _by_length(hostmask, family, length)


def _mask_halves(make, address: Column, length: Column) -> tuple[Column, Column]:
    """The halves of ``make(family, length)`` of an address's family, from tables; null for a length out of range."""
    n = length.cast("int")
    tables = {}
    for f in (4, 6):
        both = [make(f, k).rjust(16, b"\0") for k in range(unicast_length(f) + 1)]
        tables[f] = [F.array(*[F.lit(int.from_bytes(m[at : at + 8], "big", signed=True)).cast("long") for m in both]) for at in (0, 8)]
    return tuple(F.when(F.length(address) == 4, F.get(tables[4][i], n)).when(F.length(address) == 16, F.get(tables[6][i], n)) for i in (0, 1))


def first_of(address: Column, length: Column) -> Column:
    """First address of the network round ``address``."""
    (p, q), (r, s) = halves(address), _mask_halves(netmask, address, length)
    return _joined(p.bitwiseAND(r), q.bitwiseAND(s), F.length(address))


def last_of(address: Column, length: Column) -> Column:
    (p, q), (r, s) = halves(address), _mask_halves(hostmask, address, length)
    return _joined(p.bitwiseOR(r), q.bitwiseOR(s), F.length(address))


def compare_columns(a: Column, b: Column) -> Column:
    """-1, 0 or 1: IPv4 before IPv6, then by value."""
    x, y = F.struct(F.length(a).alias("n"), a.alias("a")), F.struct(F.length(b).alias("n"), b.alias("a"))
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def is_unspecified_column(a: Column) -> Column:
    return F.when(F.length(a) == 4, a == F.lit(bytes(4))).when(F.length(a) == 16, a == F.lit(bytes(16)))


def host_is_zeros_column(a: Column, length: Column) -> Column:
    return a == first_of(a, length)


def host_is_ones_column(a: Column, length: Column) -> Column:
    return a == last_of(a, length)


def unicast_length_column(a: Column) -> Column:
    return F.when(F.length(a) == 4, 32).when(F.length(a) == 16, 128)


def ipv4_text_number(text: Column) -> Column:
    """Number of a dotted text; null if it isn't one."""
    parts = F.split(text, r"\.", -1)
    numbers = [F.get(parts, F.lit(i)).try_cast("int") for i in range(4)]
    good = (F.size(parts) == 4) & text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for x in numbers:
        good = good & x.between(0, 255)
    value = sum((x.cast("long") * (1 << s) for x, s in zip(numbers, (24, 16, 8, 0), strict=True)), F.lit(0).cast("long"))
    return F.when(good, value)


def packed(text: str | None) -> bytes | None:
    """Address of a text, null if it is none: by the C library where it takes the text."""
    try:
        return None if text is None else socket.inet_pton(socket.AF_INET6 if ":" in text else socket.AF_INET, text)
    except (OSError, ValueError):
        pass
    try:
        return pton(text)
    except ValueError:
        return None


@F.pandas_udf(T.BinaryType())
def _any_address(text: pd.Series) -> pd.Series:
    return text.map(packed)


def from_text(text: Column, ipv4_only: bool = False) -> Column:
    """Address of a text, null if it is none.  IPv4 is done in the JVM; with ``ipv4_only`` no Python runs."""
    v4 = F.when(~text.contains(":"), ipv4_from_number(ipv4_text_number(text)))
    return v4 if ipv4_only else F.coalesce(v4, _any_address(text))


@F.pandas_udf(T.StringType())
def _any_text(a: pd.Series) -> pd.Series:
    return a.map(lambda x: ntop(bytes(x)) if x is not None else None)


def text(address: Column, ipv4_only: bool = False) -> Column:
    """Text of an address.  IPv4 is done in the JVM; with ``ipv4_only`` other lengths give null and no Python runs."""
    parts = [F.conv(F.hex(F.substring(address, i, 1)), 16, 10) for i in (1, 2, 3, 4)]
    v4 = F.when(F.length(address) == 4, F.concat_ws(".", *parts))
    return v4 if ipv4_only else F.coalesce(v4, _any_text(address))
