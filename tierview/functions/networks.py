"""IPv6 addresses as 16 bytes: an order, ranges and networks of all 128 bits, in built-in expressions only.

Bytes are compared unsigned from the left, which is the order of addresses, and a network or a range is one comparison
with two constants, so it reaches the statistics of a Parquet scan. Two halves of 64 bits are there for arithmetic.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(address: str) -> Column:
    return F.lit(ipaddress.IPv6Address(address).packed)


def in_range(key: Column, first: str, last: str) -> Column:
    """Whether an address (16 bytes) is from ``first`` to ``last``, both included. NULL of no address."""
    if ipaddress.IPv6Address(first) > ipaddress.IPv6Address(last):
        raise ValueError(f"{first} comes after {last}")
    return key.between(_bytes(first), _bytes(last))


def in_network(key: Column, network: str) -> Column:
    """Whether an address is in a network such as ``fe80::/10``; bits set beyond the prefix are an error."""
    net = ipaddress.IPv6Network(network)
    return in_range(key, str(net[0]), str(net[-1]))


def network_of(key: Column, bits: int) -> Column:
    """The first address of the network of ``bits`` bits that an address is in, as 16 bytes."""
    if not 0 <= bits <= 128:
        raise ValueError(f"a prefix has 0 to 128 bits, not {bits}")
    whole, rest = divmod(bits, 8)
    parts = [F.substring(key, 1, whole)]
    if rest:
        byte = F.conv(F.hex(F.substring(key, whole + 1, 1)), 16, 10).cast("int")
        kept = byte.bitwiseAND(F.lit(256 - (1 << (8 - rest))))
        parts.append(F.unhex(F.lpad(F.hex(kept), 2, "0")))
    parts.append(F.lit(bytes(16 - whole - bool(rest))))
    return F.concat(*parts)


def halves(key: Column) -> tuple[Column, Column]:
    """The upper and the lower 64 bits as unsigned numbers, DECIMAL(20,0)."""
    number = lambda at: F.conv(F.hex(F.substring(key, at, 8)), 16, 10).cast("decimal(20,0)")
    return number(1), number(9)


def from_halves(high: Column, low: Column) -> Column:
    """The 16 bytes of two halves; NULL where one is not from 0 to 2**64 - 1."""
    text = lambda half: F.lpad(F.conv(half.cast("string"), 10, 16), 16, "0")
    good = lambda half: half.between(F.lit(0), F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    return F.when(good(high) & good(low), F.unhex(F.concat(text(high), text(low))))


def distance(later: Column, earlier: Column) -> tuple[Column, Column]:
    """How many addresses ``later`` is after ``earlier``, as the two halves of a number; NULL where it is before it."""
    (ha, la), (hb, lb) = halves(later), halves(earlier)
    wrap = F.lit(str(2**64)).cast("decimal(20,0)")
    borrowed = (la < lb).cast("int")
    after = later >= earlier
    high = (ha - hb - borrowed).cast("decimal(20,0)")
    low = (la - lb + wrap * borrowed).cast("decimal(20,0)")
    return F.when(after, high), F.when(after, low)
