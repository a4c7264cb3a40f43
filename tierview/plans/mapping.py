"""Two schemas into one column list.

The result is kept as SQL expression strings, so the DataFrame form (:mod:`tierview.operators.unify`)
and the text of a persisted view (:mod:`tierview.sources.views`) are built from the same words.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tierview.functions import addresses, codec, nested, sqltext
from tierview.functions.boundaries import Boundary
from tierview.plans.spec import PartitionRule, TableSpec

log = logging.getLogger(__name__)

_ADDRESS_SUFFIX = "_int"
_REFUSED = (T.MapType, T.StructType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIME_TYPES = {
    "datetime": (T.TimestampNTZType, T.TimestampType),
    "date": (T.DateType,),
    "bigint": _INTEGRAL,
}
# Times stored in steps of one: microseconds, days, units.
_STEPWISE = (T.TimestampNTZType, T.TimestampType, T.DateType, *_INTEGRAL)

REPORT_SCHEMA = (
    "ordinal int, column string, side string, rule string, hot_type string, cold_column string, cold_type string"
)


class MappingError(ValueError):
    """The two schemas cannot be served as one table."""


@dataclass(frozen=True)
class ColumnRule:
    """How one output column is filled from the cold tier; the hot tier passes it through."""

    name: str
    rule: str
    hot_type: T.DataType
    cold_expr: str
    cold_column: str | None = None
    # What the column stands for, and how it is stored.
    cold_type: str | None = None
    stored: T.DataType | None = None


@dataclass(frozen=True)
class MappingPlan:
    columns: tuple[ColumnRule, ...]
    # Helper columns of the cold side, computed one projection at a time: (name, expression).
    cold_steps: tuple[tuple[tuple[str, str], ...], ...]
    skipped: tuple[tuple[str, str], ...]
    spec: TableSpec

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def hot_exprs(self) -> list[str]:
        return [sqltext.ident(c.name) for c in self.columns]

    @property
    def cold_exprs(self) -> list[str]:
        return [
            c.cold_expr if c.cold_expr == sqltext.ident(c.name) else f"{c.cold_expr} AS {sqltext.ident(c.name)}"
            for c in self.columns
        ]

    @property
    def time_rule(self) -> ColumnRule:
        return next(c for c in self.columns if c.name == self.spec.time_column)

    def hot_literal(self, boundary: Boundary) -> str:
        return boundary.sql(self.time_rule.hot_type)

    def hot_time_filter(self, op: str, boundary: Boundary) -> str:
        time, rule = sqltext.ident(self.spec.time_column), self.time_rule
        return _compare(time, op, boundary, rule.hot_type, rule.hot_type, self.spec.hot_partition)

    def cold_time_filter(self, op: str, boundary: Boundary) -> str:
        """Predicate on the *stored* cold columns equal to ``time <op> boundary`` on the aligned one.

        Stated on what is stored, it reaches the scan (pushed filters, row-group and partition pruning)
        also where the aligned column is a conversion that Catalyst does not look through.
        """
        rule, partition = self.time_rule, self.spec.cold_partition
        column, stored = sqltext.ident(rule.cold_column), rule.stored
        if boundary.kind == "date" and isinstance(stored, T.TimestampNTZType):
            # A day lies before another exactly when its moments lie before the other's midnight.
            day = boundary.value
            midnight = Boundary("datetime", dt.datetime(day.year, day.month, day.day))
            return _compare(column, op, midnight, stored, stored, partition)
        if isinstance(stored, T.DateType) and isinstance(rule.hot_type, T.TimestampNTZType):
            day = _day_from(boundary.value)
            if day is not None:
                # A midnight lies before a moment exactly when its day lies before the first day from then on.
                return _compare(column, op, Boundary("date", day), stored, stored, partition)
        return _compare(rule.cold_expr, op, boundary, rule.hot_type, stored, partition)


def _day_from(moment: dt.datetime) -> dt.date | None:
    """The first day whose midnight is not before the moment, None past the end of the calendar."""
    day = moment.date()
    if moment == dt.datetime(day.year, day.month, day.day):
        return day
    return None if day == dt.date.max else day + dt.timedelta(days=1)


def _compare(
    time_sql: str,
    op: str,
    boundary: Boundary,
    compared: T.DataType,
    stored: T.DataType,
    partition: PartitionRule | None,
) -> str:
    """Time comparison plus, on a partitioned tier, what it implies for the partition column.

    The partition value never falls as time rises, so a bound on time bounds it too. Below a boundary,
    the latest time possible is one step before it, provided that times are stored in such steps: a
    boundary at a partition's start then leaves that partition out.
    """
    predicate = f"{time_sql} {op} {boundary.sql(compared)}"
    if partition is None:
        return predicate
    edge = boundary
    if op == "<" and isinstance(stored, _STEPWISE) and type(stored) in (type(compared), *_INTEGRAL):
        edge = boundary.before() or boundary
    bound = {"<": "<=", ">=": ">="}[op]
    return f"{predicate} AND {sqltext.ident(partition.column)} {bound} {partition.of(edge.sql(compared))}"


def reconcile(hot: T.StructType, cold: T.StructType, spec: TableSpec) -> MappingPlan:
    """Match the cold columns to the hot ones and fill what the cold tier lacks.

    Output order: matched columns in cold order, then hot-only columns in hot order.
    """
    _check_names(hot, "hot")
    _check_names(cold, "cold")
    hot_fields = {f.name: f for f in hot.fields}
    unknown = [n for n in spec.cold_types if n not in cold.names]
    if unknown:
        raise MappingError(f"cold types declared for columns the cold tier lacks: {unknown}")
    for f in hot.fields:
        _check_type(f.name, f.dataType, spec)

    columns: list[ColumnRule] = []
    steps: list[list[tuple[str, str]]] = []
    skipped: list[tuple[str, str]] = []
    for f in cold.fields:
        declared = spec.cold_types.get(f.name, "")
        target = f.name + _ADDRESS_SUFFIX if "ipv4" in declared or "ipv6" in declared else f.name
        field = hot_fields.get(target)
        if field is None:
            log.warning("cold column %s has no hot column %s and is left out", f.name, target)
            skipped.append((f.name, declared or f.dataType.simpleString()))
            continue
        rule, expr, helpers = _cold_expression(f, declared, field, spec)
        for n, helper in enumerate(helpers):
            if n == len(steps):
                steps.append([])
            steps[n].append(helper)
        stands_for = declared or f.dataType.simpleString()
        columns.append(ColumnRule(target, rule, field.dataType, expr, f.name, stands_for, f.dataType))
    double = [n for n, k in Counter(c.name for c in columns).items() if k > 1]
    if double:
        raise MappingError(f"several cold columns map to one hot column: {double}")

    matched = {c.name for c in columns}
    for f in hot.fields:
        if f.name in matched:
            continue
        default = (f.metadata or {}).get("CURRENT_DEFAULT", "").strip()
        rule = "default" if default else "null"
        columns.append(
            ColumnRule(f.name, rule, f.dataType, f"cast({default or 'NULL'} AS {f.dataType.simpleString()})")
        )
    if not columns:
        raise MappingError("no columns to serve")
    missing = [f.name for f in hot.fields if f.name not in {c.name for c in columns}]
    if missing:
        raise MappingError(f"hot columns missing from the plan: {missing}")
    _check_time(columns, spec)
    return MappingPlan(tuple(columns), tuple(tuple(s) for s in steps), tuple(skipped), spec)


def _check_names(schema: T.StructType, side: str) -> None:
    counts = Counter(n.lower() for n in schema.names)
    clash = [n for n in schema.names if counts[n.lower()] > 1]
    if clash:
        raise MappingError(f"{side} columns repeat or differ only in case: {clash}")
    if not schema.names:
        raise MappingError(f"the {side} tier has no columns")


def _nested(data_type: T.DataType) -> bool:
    inner = data_type.elementType if isinstance(data_type, T.ArrayType) else data_type
    return isinstance(inner, (T.MapType, T.StructType)) or (inner is not data_type and isinstance(inner, T.ArrayType))


def _check_type(name: str, data_type: T.DataType, spec: TableSpec) -> None:
    if spec.nested_delimiters and _nested(data_type):
        try:
            nested.checked(data_type, spec.nested_delimiters)
        except ValueError as error:
            raise MappingError(f"column {name}: {error}") from error
        return
    if isinstance(data_type, _REFUSED):
        raise MappingError(f"column {name}: type {data_type.simpleString()} is not supported")
    try:
        codec.element_type(data_type)
    except ValueError as error:
        raise MappingError(f"column {name}: {error}") from error


def _check_time(columns: list[ColumnRule], spec: TableSpec) -> None:
    rule = next((c for c in columns if c.name == spec.time_column), None)
    if rule is None:
        raise MappingError(f"time column {spec.time_column} is not in the hot tier")
    if rule.cold_column is None:
        raise MappingError(f"time column {spec.time_column} is not in the cold tier")
    if not isinstance(rule.hot_type, _TIME_TYPES[spec.time_type]):
        raise MappingError(
            f"time column {spec.time_column} is {rule.hot_type.simpleString()}, declared as {spec.time_type}"
        )


def _cast(expr: str, source: T.DataType, target: T.DataType, strict: bool) -> str:
    if source == target or (isinstance(source, T.StringType) and isinstance(target, T.StringType)):
        return expr
    if isinstance(source, T.StringType) and isinstance(target, T.VariantType):
        return f"{'parse_json' if strict else 'try_parse_json'}({expr})"
    keyword = "cast" if strict or _never_fails(source, target) else "try_cast"
    return f"{keyword}({expr} AS {target.simpleString()})"


def _never_fails(source: T.DataType, target: T.DataType) -> bool:
    """Casts written as plain casts, which Catalyst sees through when it pushes filters."""
    if type(source) in _INTEGRAL and type(target) in _INTEGRAL:
        return _INTEGRAL.index(type(source)) <= _INTEGRAL.index(type(target))
    days, moments = isinstance(source, T.DateType), isinstance(source, _TIME_TYPES["datetime"])
    return days and isinstance(target, _TIME_TYPES["datetime"]) or moments and isinstance(target, T.DateType)


def _cold_expression(
    cold: T.StructField, declared: str, hot: T.StructField, spec: TableSpec
) -> tuple[str, str, list[tuple[str, str]]]:
    """(rule, expression, helper columns) giving the hot column from the cold one.

    Precedence: nested type, array of IPv6, array of text, any other array, address, plain column.
    """
    value, stored, wanted = sqltext.ident(cold.name), cold.dataType, hot.dataType
    text = isinstance(stored, T.StringType)

    if _nested(wanted):
        if text:
            return "decode_nested", nested.decode_sql(value, wanted, spec.nested_delimiters, spec.strict), []
        if stored != wanted:
            raise MappingError(f"cold column {cold.name} is {stored.simpleString()}, neither {wanted.simpleString()} nor text")
        return _plain(value, stored, wanted, spec)

    if "array" in declared or isinstance(wanted, T.ArrayType):
        if not isinstance(wanted, T.ArrayType):
            raise MappingError(f"cold column {cold.name} is an array, hot column {hot.name} is not")
        if text:
            # In the delimited form addresses are already numbers.
            rule = "decode_ipv6" if "ipv6" in declared else "decode_text"
            if rule == "decode_text" and not isinstance(wanted.elementType, T.StringType):
                rule = "decode_typed"
            return rule, codec.decode_sql(value, wanted.elementType, spec.delimiter, spec.strict), []
        if not isinstance(stored, T.ArrayType):
            raise MappingError(f"cold column {cold.name} is {stored.simpleString()}, neither an array nor text")
        if isinstance(stored.elementType, T.StringType) and "ipv" in declared:
            builders = addresses.IPV6_STEPS if "ipv6" in declared else (addresses.ipv4_sql,)
            kind = codec.INT128 if "ipv6" in declared else T.LongType()
            numbers = addresses.array_sql(value, builders)
            return "array_address", _cast(numbers, T.ArrayType(kind), wanted, spec.strict), []
        return _plain(value, stored, wanted, spec)

    if declared == "ipv4" and text:
        return "ipv4", _cast(addresses.ipv4_sql(value), T.LongType(), wanted, spec.strict), []
    if declared == "ipv6" and text:
        helpers, current = [], value
        builders: list[Callable[[str], str]] = list(addresses.IPV6_STEPS)
        for n, builder in enumerate(builders[:-1]):
            name = f"__{hot.name}_{n}"
            helpers.append((name, builder(current)))
            current = sqltext.ident(name)
        return "ipv6", _cast(builders[-1](current), codec.INT128, wanted, spec.strict), helpers
    if declared == "ipv6" and isinstance(stored, T.BinaryType):
        name = f"__{hot.name}_0"
        numbers = addresses.ipv6_value_sql(sqltext.ident(name))
        return "ipv6", _cast(numbers, codec.INT128, wanted, spec.strict), [(name, f"hex({value})")]
    return _plain(value, stored, wanted, spec)


def _plain(value: str, stored: T.DataType, wanted: T.DataType, spec: TableSpec) -> tuple[str, str, list]:
    expr = _cast(value, stored, wanted, spec.strict)
    return ("plain" if expr == value else "cast"), expr, []


def mapping_report(spark: SparkSession, plan: MappingPlan) -> DataFrame:
    """One row per column of either tier and what became of it."""
    rows = [
        (n, c.name, "both" if c.cold_column else "hot", c.rule, c.hot_type.simpleString(), c.cold_column, c.cold_type)
        for n, c in enumerate(plan.columns)
    ]
    rows += [(None, name, "cold", "dropped", None, name, kind) for name, kind in plan.skipped]
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def mapping_counts(plan: MappingPlan) -> dict[str, int]:
    """Cold columns used and left out, hot-only columns, columns served."""
    used = sum(c.cold_column is not None for c in plan.columns)
    return {
        "processed": used,
        "skipped": len(plan.skipped),
        "hot_only": len(plan.columns) - used,
        "final": len(plan.columns),
    }
