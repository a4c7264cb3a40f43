"""IPv4 and IPv6 text as unsigned integers, in built-in expressions only.

An address whose value needs more than 38 digits (``fc00::/7``, ``fe80::/10``, ...) has no DECIMAL(38,0)
form and gives NULL, as does malformed text; :func:`with_ipv6_bytes` keeps every address as 16 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.functions import sqltext

# The last part means "nothing follows": unlike ``$`` it does not accept a trailing newline.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = f"^{_OCTET}(?:[.]{_OCTET}){{3}}(?!(?s:.))"


def ipv4_sql(value: str) -> str:
    """SQL text: dotted quad to BIGINT; octets of 0-255 without leading zeros, anything else NULL."""
    octets = [f"substring_index(substring_index({value}, '.', {n}), '.', -1)" for n in range(1, 5)]
    terms = [f"try_cast({octet} AS bigint) * {256 ** (3 - n)}" for n, octet in enumerate(octets)]
    return f"CASE WHEN {value} RLIKE '{_IPV4}' THEN {' + '.join(terms)} END"


def ipv6_plain_sql(value: str) -> str:
    """Step 1: write an embedded dotted quad as two hex groups."""
    quad = f"substring_index({value}, ':', -1)"
    head = f"substr({value}, 1, length({value}) - length({quad}))"
    tail = f"lpad(hex({ipv4_sql(quad)}), 8, '0')"
    return (
        f"CASE WHEN contains({value}, '.') THEN concat({head}, substr({tail}, 1, 4), ':', substr({tail}, 5, 4)) "
        f"ELSE {value} END"
    )


def ipv6_groups_sql(plain: str) -> str:
    """Step 2: the groups, with ``::`` written out as the zero groups it stands for.

    Whether they are eight groups of one to four digits is for the next step to see: every misuse of
    colons leaves another number of groups or an empty one, except for two ``::``, refused here.
    """
    colons = f"length({plain}) - length(replace({plain}, ':', ''))"
    first, last = f"startswith({plain}, '::')", f"endswith({plain}, '::')"
    zeros = f"substr(repeat(':0', 8 - ({colons}) + cast({first} AS int) + cast({last} AS int)), 2)"
    full = f"replace({plain}, '::', concat(if({first}, '', ':'), {zeros}, if({last}, '', ':')))"
    return f"CASE WHEN length({plain}) - length(replace({plain}, '::', '')) <= 2 THEN split({full}, ':') END"


def ipv6_hex_sql(groups: str) -> str:
    """Step 3: the groups as 32 characters, NULL unless they have the lengths of an address."""
    members = [f"get({groups}, {n})" for n in range(8)]
    lengths = ", ".join(f"length({m})" for m in members)
    digits = ", ".join(f"lpad({m}, 4, '0')" for m in members)
    return (
        f"CASE WHEN size({groups}) = 8 AND least({lengths}) >= 1 AND greatest({lengths}) <= 4 "
        f"THEN concat({digits}) END"
    )


def ipv6_bytes_sql(hex_digits: str) -> str:
    """Step 4: the 16 bytes; NULL when a character is not a hex digit."""
    return f"unhex({hex_digits})"


def ipv6_value_sql(hex_digits: str) -> str:
    """Step 4: the DECIMAL(38,0) value; NULL when it does not fit or a character is not a hex digit."""

    def half(start: int) -> str:
        return f"cast(conv(substr({hex_digits}, {start}, 16), 16, 10) AS decimal(20,0))"

    shifted = f"try_multiply({half(1)}, cast({2 ** 64} AS decimal(20,0)))"
    value = f"cast(try_add({shifted}, {half(17)}) AS decimal(38,0))"
    return f"CASE WHEN unhex({hex_digits}) IS NOT NULL THEN {value} END"


IPV6_STEPS = (ipv6_plain_sql, ipv6_groups_sql, ipv6_hex_sql, ipv6_value_sql)
_IPV6_BYTE_STEPS = (*IPV6_STEPS[:-1], ipv6_bytes_sql)


def array_sql(value: str, steps) -> str:
    """Apply expression builders, one after the other, to every element of an array."""
    for step in steps:
        value = f"transform({value}, a -> {step('a')})"
    return value


def ipv4_to_int(name: str) -> Column:
    return F.expr(ipv4_sql(sqltext.ident(name)))


def _stepwise(df: DataFrame, source: str, target: str, steps) -> DataFrame:
    # One column per step: each step names its input several times, so writing it as a single
    # expression would multiply the text, and Catalyst keeps such projections apart for that reason.
    helpers, current = [], source
    for n, step in enumerate(steps):
        name = target if n == len(steps) - 1 else f"__{target}_{n}"
        df = df.withColumn(name, F.expr(step(sqltext.ident(current))))
        helpers.append(name)
        current = name
    return df.drop(*helpers[:-1])


def with_ipv6_int(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: the DECIMAL(38,0) value of the IPv6 text in ``source``."""
    return _stepwise(df, source, target, IPV6_STEPS)


def with_ipv6_bytes(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: the 16 bytes of the IPv6 text in ``source``; no address is out of range."""
    return _stepwise(df, source, target, _IPV6_BYTE_STEPS)
