r"""Arrays, structs and maps of any depth as delimited text, and back, without loss.

Each level of a type has a delimiter of its own: an array and a struct one, a map two (between entries, and between a
key and its value). In what stands at the leaves the first character of each delimiter is written as a backslash and the
delimiter's number, and a backslash as ``\e``; so no text at a leaf can begin a delimiter. ``\n`` stands for NULL and
``\z`` for an array or map without elements, which ``''`` cannot be told from. Leaves are Spark's own text of a value,
binary ones in hex.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext

# Separators of files, groups, records and units, which text hardly has.
DELIMITERS = ("\x1e", "\x1f", "\x1d", "\x1c")

_ESCAPED = "\\e"


def levels(data_type: T.DataType) -> int:
    """How many delimiters a type takes."""
    if isinstance(data_type, T.ArrayType):
        return 1 + levels(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return 2 + max(levels(data_type.keyType), levels(data_type.valueType))
    if isinstance(data_type, T.StructType):
        return 1 + max((levels(f.dataType) for f in data_type.fields), default=0)
    if isinstance(data_type, (T.VariantType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType)):
        raise ValueError(f"{data_type.simpleString()} has no text that can be read back")
    return 0


def checked(data_type: T.DataType, delimiters: Sequence[str]) -> Sequence[str]:
    """The delimiters, which must be enough and have no character in common with each other or with the escapes."""
    needed = levels(data_type)
    if needed > len(delimiters):
        raise ValueError(f"{data_type.simpleString()} takes {needed} delimiters, not {len(delimiters)}")
    if needed > 9:
        raise ValueError("types of more than nine levels are not supported")
    used = [c for d in delimiters for c in set(d)]
    if not all(delimiters) or len(used) != len(set(used)) or set(used) & set("\\enz0123456789"):
        raise ValueError("delimiters must not be empty, share a character, or hold a backslash, a digit, e, n or z")
    return delimiters


_string = sqltext.string


def _null(level: int) -> str:
    return _string(f"\\n{level}")


def _none(level: int) -> str:
    return _string(f"\\z{level}")


def _written(value: str, delimiters: Sequence[str]) -> str:
    out = f"replace({value}, {_string(chr(92))}, {_string(_ESCAPED)})"
    for n, delimiter in enumerate(delimiters):
        out = f"replace({out}, {_string(delimiter[0])}, {_string(chr(92) + str(n))})"
    return out


def _read(value: str, delimiters: Sequence[str]) -> str:
    out = value
    for n, delimiter in enumerate(delimiters):
        out = f"replace({out}, {_string(chr(92) + str(n))}, {_string(delimiter[0])})"
    return f"replace({out}, {_string(_ESCAPED)}, {_string(chr(92))})"


def encode_sql(value: str, data_type: T.DataType, delimiters: Sequence[str] = DELIMITERS) -> str:
    """SQL text of the delimited text of ``value``; never NULL."""
    return _encoded(value, data_type, checked(data_type, delimiters), 0)


def _encoded(value: str, kind: T.DataType, delimiters: Sequence[str], level: int) -> str:
    null = _null(level)
    if isinstance(kind, T.ArrayType):
        name = f"x{level}"
        inner = _encoded(name, kind.elementType, delimiters, level + 1)
        joined = f"array_join(transform({value}, {name} -> {inner}), {_string(delimiters[level])})"
        return f"CASE WHEN {value} IS NULL THEN {null} WHEN size({value}) = 0 THEN {_none(level)} ELSE {joined} END"
    if isinstance(kind, T.MapType):
        name, mark = f"x{level}", _string(delimiters[level + 1])
        key, own = (_encoded(f"{name}.{part}", t, delimiters, level + 2) for part, t in (("key", kind.keyType), ("value", kind.valueType)))
        entries = f"transform(map_entries({value}), {name} -> concat({key}, {mark}, {own}))"
        joined = f"array_join({entries}, {_string(delimiters[level])})"
        return f"CASE WHEN {value} IS NULL THEN {null} WHEN size({value}) = 0 THEN {_none(level)} ELSE {joined} END"
    if isinstance(kind, T.StructType):
        parts = [_encoded(f"{value}.{sqltext.ident(f.name)}", f.dataType, delimiters, level + 1) for f in kind.fields]
        return f"CASE WHEN {value} IS NULL THEN {null} ELSE concat_ws({_string(delimiters[level])}, {', '.join(parts)}) END"
    text = f"hex({value})" if isinstance(kind, T.BinaryType) else f"cast({value} AS string)"
    return f"coalesce({_written(text, delimiters)}, {null})"


def decode_sql(value: str, data_type: T.DataType, delimiters: Sequence[str] = DELIMITERS, strict: bool = False) -> str:
    """SQL text of the value that delimited text stands for.

    NULL text is NULL. Leaves that do not parse are NULL, or fail the query when ``strict``. A struct with another number
    of fields is NULL, or fails the query; so does a map whose entry is no pair, or has a NULL key.
    """
    return _decoded(value, data_type, checked(data_type, delimiters), 0, strict)


def _decoded(value: str, kind: T.DataType, delimiters: Sequence[str], level: int, strict: bool) -> str:
    null, typed = _null(level), kind.simpleString()
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        parts = f"split({value}, {sqltext.literal_regex(delimiters[level])}, -1)"
    bad = "raise_error('delimited text does not fit its type')" if strict else "NULL"
    if isinstance(kind, T.ArrayType):
        name = f"x{level}"
        inner = _decoded(name, kind.elementType, delimiters, level + 1, strict)
        full = f"transform({parts}, {name} -> {inner})"
        return f"CASE WHEN {value} = {null} THEN NULL WHEN {value} = {_none(level)} THEN cast(array() AS {typed}) ELSE {full} END"
    if isinstance(kind, T.MapType):
        name = f"x{level}"
        pair = f"split({name}, {sqltext.literal_regex(delimiters[level + 1])}, -1)"
        key, own = (
            _decoded(f"get({pair}, {n})", t, delimiters, level + 2, strict) for n, t in enumerate((kind.keyType, kind.valueType))
        )
        entries = f"transform({parts}, {name} -> struct({key} AS key, {own} AS value))"
        good = f"forall({parts}, {name} -> size({pair}) = 2 AND ({key}) IS NOT NULL)"
        full = f"CASE WHEN {good} THEN map_from_entries({entries}) ELSE {bad} END"
        return f"CASE WHEN {value} = {null} THEN NULL WHEN {value} = {_none(level)} THEN cast(map() AS {typed}) ELSE {full} END"
    if isinstance(kind, T.StructType):
        fields = [
            f"{_decoded(f'get({parts}, {n})', f.dataType, delimiters, level + 1, strict)} AS {sqltext.ident(f.name)}"
            for n, f in enumerate(kind.fields)
        ]
        full = f"CASE WHEN size({parts}) = {len(fields)} THEN struct({', '.join(fields)}) ELSE {bad} END"
        return f"CASE WHEN {value} = {null} THEN NULL WHEN {value} IS NOT NULL THEN {full} END"
    text = _read(value, delimiters)
    if isinstance(kind, T.BinaryType):
        text = f"unhex({text})"
    elif not isinstance(kind, T.StringType):
        text = f"{'cast' if strict else 'try_cast'}({text} AS {typed})"
    return f"CASE WHEN {value} <> {null} THEN {text} END"


def encode(name: str, data_type: T.DataType, delimiters: Sequence[str] = DELIMITERS) -> Column:
    return F.expr(encode_sql(sqltext.ident(name), data_type, delimiters))


def decode(name: str, data_type: T.DataType, delimiters: Sequence[str] = DELIMITERS, strict: bool = False) -> Column:
    return F.expr(decode_sql(sqltext.ident(name), data_type, delimiters, strict))
