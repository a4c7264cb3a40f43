"""Derived columns of a cold table: numbers of addresses, delimited text of arrays. Never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import addresses, codec, sqltext
from tierview.plans.spec import TableSpec


def alias_names(schema: T.StructType, spec: TableSpec) -> dict[str, str]:
    """Source column to alias column: ``x_int`` for addresses, ``x_str`` for native arrays."""
    names = {}
    for f in schema.fields:
        declared = spec.cold_types.get(f.name, "")
        if declared in ("ipv4", "ipv6"):
            names[f.name] = f"{f.name}_int"
        elif isinstance(f.dataType, T.ArrayType):
            names[f.name] = f"{f.name}_str"
    return names


def with_aliases(cold: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the derived columns.

    An array of addresses is written as numbers. An array that the text form cannot hold gives NULL, or
    fails the query when the spec is strict.
    """
    schema = cold.schema
    for source, alias in alias_names(schema, spec).items():
        declared = spec.cold_types.get(source, "")
        value = sqltext.ident(source)
        if declared == "ipv4":
            cold = cold.withColumn(alias, F.expr(addresses.ipv4_sql(value)))
        elif declared == "ipv6":
            cold = addresses.with_ipv6_int(cold, source, alias)
        else:
            steps = {"array<ipv4>": (addresses.ipv4_sql,), "array<ipv6>": addresses.IPV6_STEPS}.get(declared, ())
            numbers = addresses.array_sql(value, steps)
            cold = cold.withColumn(alias, F.expr(numbers)).withColumn(
                alias, codec.encode_array(alias, spec.delimiter, spec.strict)
            )
    return cold


def without_aliases(cold: DataFrame, schema: T.StructType, spec: TableSpec) -> DataFrame:
    """Drop the derived columns again; ``schema`` is that of the table without them."""
    return cold.drop(*alias_names(schema, spec).values())
