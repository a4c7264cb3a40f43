"""Arrays stored as delimited text: decode, encode, and the checks around them.

Every expression here is free of lambdas on the usual path: ``try_cast(split(..) AS array<T>)`` casts
element by element and stays inside whole-stage code generation, where ``transform`` would not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext

# Fixed value: the element separator existing cold tables were written with.
DEFAULT_DELIMITER = "CKTOSRFRAGEMENT"

# A signed 128-bit integer column; Spark's widest exact integer is 38 digits.
INT128 = T.DecimalType(38, 0)


def decode_sql(value: str, element: T.DataType, delimiter: str = DEFAULT_DELIMITER, strict: bool = False) -> str:
    """SQL text turning delimited text into ``array<element>``.

    Empty text is the empty array, NULL stays NULL, trailing empty elements are kept. An element that
    does not parse becomes NULL, or fails the query when ``strict``.
    """
    array = f"array<{element.simpleString()}>"
    parts = f"split({value}, {sqltext.literal_regex(delimiter)}, -1)"
    if not isinstance(element, T.StringType):
        parts = f"{'cast' if strict else 'try_cast'}({parts} AS {array})"
    return f"CASE WHEN {value} = '' THEN cast(array() AS {array}) ELSE {parts} END"


def decode_array(name: str, element: T.DataType, delimiter: str = DEFAULT_DELIMITER, strict: bool = False) -> Column:
    return F.expr(decode_sql(sqltext.ident(name), element, delimiter, strict))


def joined_sql(value: str, delimiter: str = DEFAULT_DELIMITER) -> str:
    """Elements as text, joined; says nothing about whether the text can be decoded again."""
    return f"array_join(cast({value} AS array<string>), {sqltext.string(delimiter)})"


def encodable_sql(value: str, delimiter: str = DEFAULT_DELIMITER) -> str:
    """True when decoding the joined text gives the array back; true for a NULL array.

    False for NULL elements (they vanish), for ``['']`` (same text as ``[]``) and for elements that
    hold the delimiter or build one together with their neighbour.
    """
    again = decode_sql(joined_sql(value, delimiter), T.StringType(), delimiter)
    return f"(({again}) <=> cast({value} AS array<string>))"


def encode_sql(value: str, delimiter: str = DEFAULT_DELIMITER, strict: bool = True) -> str:
    """Delimited text of an array. What cannot be decoded again is an error, or NULL if not ``strict``."""
    refusal = "raise_error('array cannot be stored as delimited text without loss')" if strict else "NULL"
    return f"CASE WHEN {encodable_sql(value, delimiter)} THEN {joined_sql(value, delimiter)} ELSE {refusal} END"


def encode_array(name: str, delimiter: str = DEFAULT_DELIMITER, strict: bool = True) -> Column:
    return F.expr(encode_sql(sqltext.ident(name), delimiter, strict))


def is_encodable(name: str, delimiter: str = DEFAULT_DELIMITER) -> Column:
    return F.expr(encodable_sql(sqltext.ident(name), delimiter))


def element_type(data_type: T.DataType) -> T.DataType:
    """Element type of an array type, any other type unchanged; nested arrays are refused."""
    if not isinstance(data_type, T.ArrayType):
        return data_type
    if isinstance(data_type.elementType, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"nested type {data_type.simpleString()} is not supported")
    return data_type.elementType
